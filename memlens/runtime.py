"""Session helpers: durable cuts of the lineage and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (bytes as Spark estimates them) that an operator may broadcast.
BROADCAST_BYTES = 32 << 20
#: Keys that a hot key of a join is made of.
SALTS = 64


def session(app: str = "memlens", cpus: str | int = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, local runs) a temporary folder is
    made and set. Off a local master that would lie on one machine, so it is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        path = getattr(spark, "_memlens_dir", None)
        if not path or not os.path.isdir(path):
            path = tempfile.mkdtemp(prefix="memlens-")
            spark._memlens_dir = path
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path.rstrip("/")


#: This process's own part of the shared folder, so that ending it can't touch what others wrote.
_OWN = f"memlens-{uuid.uuid4().hex}"


def new_table(spark: SparkSession) -> str:
    """A fresh path for a written table in the shared folder."""
    folder = f"{shared_dir(spark)}/{_OWN}"
    _folders.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


_folders: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete all written tables of this process; results that still read them become unusable."""
    for folder in list(_folders):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _folders.discard(folder)


@atexit.register
def _clean() -> None:
    """On a mounted folder the tables go with the process; elsewhere :func:`release` has to be called."""
    for folder in _folders:
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond the files, so a lost executor costs the
    reading of its files and nothing else; Spark also knows its true size.
    """
    spark = df.sparkSession
    path = new_table(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memlens_cut = True
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's size estimate of a plan; true file size for a cut table."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven under ``limit``, else as it is.

    An estimate proves nothing (an explode or a join may exceed it), so a table that is not cut yet is cut first and its files
    are measured. Past the limit Spark plans an ordinary shuffled join.
    """
    known = df if getattr(df, "_memlens_cut", False) else cut(df)
    return F.broadcast(known) if estimated_bytes(known) <= limit else known


def skew_join(rows: DataFrame, few: DataFrame, on: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``few`` on keys of which one may hold most of ``rows``.

    ``few`` is broadcast if proven small; else each of its rows is repeated for every salt and ``rows`` are spread over the salts by a hash of
    themselves, so a hot key becomes ``salts`` keys.
    """
    few = cut(few)
    if estimated_bytes(few) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), on)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_key(col: Column) -> Column:
    """An id without blanks around it and in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


#: Attempts after the first, first and longest wait in seconds; of a service elsewhere and of one on this machine.
REMOTE, LOCAL = (3, 0.1, 10.0), (2, 0.05, 0.5)


def waits(budget: tuple[int, float, float] = REMOTE, factor: float = 2.0) -> list[float]:
    """Seconds to wait before each further attempt."""
    times, first, most = budget
    return [min(first * factor**n, most) for n in range(times)]


def retry(call, budget: tuple[int, float, float] = REMOTE, again=lambda error: True, sleep=time.sleep):
    """``call()``, repeated after growing waits as long as ``again(error)`` allows; the last error is raised."""
    for wait in [*waits(budget), None]:
        try:
            return call()
        except Exception as error:
            if wait is None or not again(error):
                raise
            sleep(wait)
