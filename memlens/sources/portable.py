"""Files in and out: portable JSON exports, trainer message lines, Q tables, model folders, configuration."""

from __future__ import annotations

import copy
import json
import math
import os
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from memlens.operators.store import portable
from memlens.schemas import MEMORY, PORTABLE

_ROW = StructType([f for f in MEMORY if f.name in PORTABLE])
ENVELOPE = StructType([StructField("version", IntegerType()), StructField("memories", ArrayType(_ROW))])
#: One trainer message a line, told apart by ``type``.
MESSAGE = StructType(
    [StructField(n, t) for n, t in (
        ("type", StringType()), ("stage", StringType()), ("percent", DoubleType()), ("message", StringType()),
        ("id", StringType()), ("context", StringType()), ("action", StringType()), ("result", StringType()), ("insight_type", StringType()),
        ("source_ids", StringType()), ("tags", StringType()), ("target_id", StringType()), ("reasoning", StringType()), ("name", StringType()),
        ("value", DoubleType()), ("path", StringType()), ("size_bytes", LongType()), ("insights_generated", LongType()), ("duration_ms", LongType()),
    )]
)


class BadInput(ValueError):
    """A file that can't be taken as it is."""


def open_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet table of a fixed schema; an empty one where the folder does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of export files, one JSON envelope a file (or a line); version 1 only."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ENVELOPE, {"mode": "FAILFAST"}).alias("e"))
    if (bad := raw.where("e.version is null or e.version <> 1").select("e.version").first()) is not None:
        raise BadInput(f"export version {bad['version']} is not supported")
    return raw.select(F.explode("e.memories").alias("m")).select("m.*")


def write_export(memories: DataFrame, path: str) -> None:
    """Portable rows as JSON lines, each task its own file; nulls are written out."""
    portable(memories).write.option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Portable rows of JSON lines as :func:`write_export` writes them."""
    return spark.read.schema(_ROW).option("mode", "FAILFAST").json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Trainer messages; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(MESSAGE).option("mode", "FAILFAST").json(path).where("type is not null")


def message(kind: str, **fields: Column) -> Column:
    """A message column of that type as JSON text."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()]))


def insights_of(messages: DataFrame) -> DataFrame:
    """Insight messages as insights; other kinds are dropped."""
    return messages.where("type = 'insight'").select("id", "context", "action", "result", "insight_type", "source_ids", "tags")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, modified) of model files, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{onnx,json,data,txt}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("name")


def models_stale(spark: SparkSession, folder: str, changed_at) -> bool:
    """Whether the newest model is older than ``changed_at``; no models count as stale."""
    newest = model_files(spark, folder).where(F.col("name").endswith(".onnx")).agg(F.max("modified").alias("m")).first()["m"]
    return newest is None or newest < changed_at


def to_lines(df: DataFrame, form: str = "jsonl") -> DataFrame:
    """(value): rows as JSON lines, or as ``name: value`` text."""
    if form == "jsonl":
        return df.select(F.to_json(F.struct("*")).alias("value"))
    return df.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]).alias("value"))


def response(id_: Column, data: Column, code: Column | None = None, text: Column | None = None) -> Column:
    """A response as JSON text: {id, ok: true, data} or, where ``code`` is not null, {id, ok: false, error: {code, message}}."""
    good = F.to_json(F.struct(id_.alias("id"), F.lit(True).alias("ok"), data.alias("data")))
    if code is None:
        return good
    bad = F.to_json(F.struct(id_.alias("id"), F.lit(False).alias("ok"), F.struct(code.alias("code"), text.alias("message")).alias("error")))
    return F.when(code.isNull(), good).otherwise(bad)


def search_lines(hits: DataFrame, queries: DataFrame, degraded: Column, form: str = "jsonl") -> DataFrame:
    """(query_id, line, value): a line for each hit in order and a last one that says whether the search was degraded."""
    shown = ["id", "score", "context", "action", "result", "memory_type", "tags"]
    own = hits.select("query_id", F.col("place").alias("line"), to_value(F.struct(*shown), shown, form).alias("value"))
    last = F.to_json(F.struct(degraded.alias("degraded"))) if form == "jsonl" else F.concat(F.lit("degraded: "), degraded.cast("string"))
    return own.unionByName(queries.select("query_id", F.lit(2**31 - 1).alias("line"), last.alias("value")))


def to_value(row: Column, names: list[str], form: str) -> Column:
    if form == "jsonl":
        return F.to_json(row)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(row[c].cast("string"), F.lit(""))) for c in names])


def error_line(error: Exception) -> str:
    """What a job that failed says last, as one message line."""
    return json.dumps({"type": "error", "message": str(error)})


# -- configuration

DEFAULTS = {
    "search": {"rrf_k": 60.0, "vector_weight": 0.7, "text_weight": 0.3},
    "dedup": {"threshold": 0.95, "fts_floor": 0.0},
    "consolidate": {"stale_days": 90, "min_score": 0.3},
    "embedding": {"dimension": 1024},
}


def merge_config(*layers: dict) -> dict:
    """Layers from weakest to strongest: tables merge, arrays and values are replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(global_file: str | None = None, project_file: str | None = None, env: dict[str, str] | None = None, prefix: str = "MEMLENS_") -> dict:
    """Defaults, then the global file, the project file (never its secrets) and variables like MEMLENS_SEARCH__RRF_K."""
    read = lambda f: tomllib.loads(Path(f).read_text()) if f and Path(f).exists() else {}
    project = read(project_file)
    for part in project.values():
        if isinstance(part, dict):
            part.pop("api_key", None)
    given: dict = {}
    for name, value in (env if env is not None else os.environ).items():
        if name.startswith(prefix) and "__" in name:
            table, key = name[len(prefix) :].lower().split("__", 1)
            given.setdefault(table, {})[key] = tomllib.loads(f"v = {value}")["v"] if _number(value) else value
    out = merge_config(DEFAULTS, read(global_file), project, given)
    check_config(out)
    return out


def _number(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False


def check_config(config: dict) -> None:
    s, d = config["search"], config["dedup"]
    if not 0 < d["threshold"] <= 1:
        raise BadInput("dedup threshold must lie in (0, 1]")
    if not (math.isfinite(d["fts_floor"]) and d["fts_floor"] >= 0):
        raise BadInput("the floor must be finite and not negative")
    weights = (s["vector_weight"], s["text_weight"])
    if not s["rrf_k"] > 0 or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise BadInput("rrf_k must be positive and the weights finite, not negative and not both 0")


def public_config(config: dict) -> dict:
    """The configuration with keys replaced by whether they are set."""
    out = copy.deepcopy(config)
    for part in out.values():
        if isinstance(part, dict) and "api_key" in part:
            part["has_api_key"] = bool(part.pop("api_key"))
    return out

