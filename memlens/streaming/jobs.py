"""Streams: requests a line, feedback state, ordered bandit folds and reindexing batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlens.operators.routing import ALPHA
from memlens.operators.store import reindex_candidates
from memlens.runtime import shared_dir
from memlens.schemas import FEEDBACK

REQUEST = "id string, method string, params map<string,string>"
BAD_JSON = 4000


def checkpoint(spark: SparkSession, name: str) -> str:
    """Where a stream keeps its progress: the shared folder."""
    return f"{shared_dir(spark)}/streams/{name}"


def requests(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (value) as requests and as errors (value, code): what is no JSON object goes to the errors."""
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", REQUEST))
    good = F.col("r.method").isNotNull()
    return parsed.where(good).select("r.*"), parsed.where(~good).select("value", F.lit(BAD_JSON).alias("code"))


def serve(spark: SparkSession, folder: str, name: str, handle: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Run ``handle(requests, errors, batch)`` on each micro-batch of a folder of request lines until all are read."""

    def each(batch: DataFrame, number: int) -> None:
        good, bad = requests(batch)
        handle(good, bad, number)

    lines = spark.readStream.text(folder)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint(spark, name)).trigger(availableNow=True).start()


def read_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).parquet(folder)


def judged_state(feedback: DataFrame) -> DataFrame:
    """(memory_id, shown, judged) as it stands: once judged, always judged. For update or complete mode."""
    return feedback.groupBy("memory_id").agg(F.count("*").alias("shown"), F.max(F.coalesce("judged", F.lit(False))).alias("judged"))


def shown_by_window(feedback: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows and judgements of each window of search time; rows later than ``late`` drop out and windows close."""
    from memlens.functions.timeutil import instant

    timed = feedback.withColumn("at", instant(F.col("searched_at"))).where("at is not null").withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count("*").alias("shown"), F.count_if("judged").alias("judged")).select("window.start", "shown", "judged")


def fold_stream(events: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Running (router_level, state, action, value, update_count) of a stream of rewards with ``seq``.

    A batch's events of a key are sorted by ``seq`` before they are folded; an event older than what a key
    has folded is folded when it comes. Null rewards don't count. Update mode.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, count = state.get if state.exists else (0.0, 0)
        for reward in pd.concat(list(frames)).sort_values("seq")["reward"].dropna():
            value += alpha * (reward - value)
            count += 1
        state.update((value, count))
        yield pd.DataFrame([(*key, value, count)], columns=["router_level", "state", "action", "value", "update_count"])

    return events.groupBy("router_level", "state", "action").applyInPandasWithState(
        fold, "router_level string, state string, action string, value double, update_count long", "value double, count long", "update", GroupStateTimeout.NoTimeout
    )


def reindex(memories: DataFrame, embed: Callable[[DataFrame], DataFrame], limit: int = 100) -> DataFrame:
    """One tick of the background index: the ids it indexed, at most ``limit``. ``embed`` gives (id) of what it could embed."""
    return embed(reindex_candidates(memories, limit))


def reindex_every(spark: SparkSession, seconds: int, tick: Callable[[int], None], name: str = "reindex", once: bool = False) -> StreamingQuery | None:
    """Call ``tick(number)`` every so many seconds, the first time after one interval; 0 seconds is off.

    ``tick`` reads the snapshot of its time and writes the next, see :func:`reindex`. With ``once`` the second tick ends the stream, for tests.
    """
    if seconds <= 0:
        return None

    def each(batch: DataFrame, number: int) -> None:
        if number:  # the first is at the start
            tick(number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint(spark, name))
    query = writer.trigger(processingTime=f"{seconds} seconds").start()
    if once:
        while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < 1):
            query.awaitTermination(1)
        query.stop()
    return query
