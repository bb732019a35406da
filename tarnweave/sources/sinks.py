"""Sinks: JSON lines, review tables, status partitions, versioned indexes, append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import text
from tarnweave.operators.review import normal_status
from tarnweave.sources.files import path_exists


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; the job's commit makes the folder appear whole or not at all."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, previews: dict[str, int] | None = None) -> None:
    """CSV with a header; arrays, maps and structs as JSON, long texts cut to a preview where asked."""
    out = []
    for f in rows.schema.fields:
        c: Column = F.col(f.name)
        if f.dataType.typeName() in ("array", "map", "struct"):
            c = F.to_json(c)
        if previews and f.name in previews:
            c = text.preview(c, previews[f.name])
        out.append(c.alias(f.name))
    rows.select(*out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by_status(rows: DataFrame, path: str, column: str = "review_status") -> None:
    """Rows in a folder per normalised status; statuses that aren't in ``rows`` stay as they are."""
    rows.withColumn(column, normal_status(F.col(column))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_by_status(spark: SparkSession, path: str) -> DataFrame:
    """All statuses in one table with status_rank, by which pending comes first."""
    rows = spark.read.parquet(path)
    return rows.withColumn("status_rank", F.when(F.col("review_status") == "pending", 0).when(F.col("review_status") == "approved", 1).otherwise(2))


def publish(rows: DataFrame, root: str, check: Callable[[DataFrame], bool]) -> str:
    """Write a new version below ``root``, check it as read back, and name it the current one; a failing version is never named."""
    spark = rows.sparkSession
    version = f"{root}/versions/{uuid.uuid4().hex}"
    rows.write.parquet(version)
    if not check(spark.read.parquet(version)):
        raise ValueError("the new version isn't healthy; the current one stays")
    _log(spark, root, version, "publish")
    return version


def _log(spark: SparkSession, root: str, version: str, action: str) -> None:
    seq = spark.read.json(f"{root}/log").agg(F.max("seq")).first()[0] + 1 if path_exists(spark, f"{root}/log") else 0
    spark.createDataFrame([(seq, version, action)], "seq long, version string, action string").coalesce(1).write.mode("append").json(f"{root}/log")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was named last."""
    return spark.read.parquet(spark.read.json(f"{root}/log").orderBy(F.desc("seq")).first()["version"])


def roll_back(spark: SparkSession, root: str) -> str:
    """Name the version before the current one again."""
    log = spark.read.json(f"{root}/log").orderBy(F.desc("seq"))
    now = log.first()["version"]
    earlier = log.where(F.col("version") != now).first()
    if earlier is None:
        raise ValueError("there is no earlier version")
    _log(spark, root, earlier["version"], "rollback")
    return earlier["version"]


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of keys that ``new`` has are replaced, others stay: the form of every keyed overwrite on plain files."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def embed_missing(chunks: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], model: str, key: str = "content_sha256", body: str = "content") -> DataFrame:
    """New rows (model, key, embedding) for contents that the cache of this model lacks, each content once."""
    own = cache.where(F.col("model") == model).select(key)
    return chunks.select(key, body).dropDuplicates([key]).join(own, key, "left_anti").select(F.lit(model).alias("model"), key, embed(F.col(body)).alias("embedding"))


def cache_report(cache: DataFrame, sample: int = 200) -> DataFrame:
    """(model, rows, dimensions, zero, invalid) of an embedding cache."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    bad = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return cache.groupBy("model").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.size("embedding"))).alias("dimensions"), F.count_if(F.sqrt(norm) <= 1e-9).alias("zero"), F.count_if(bad).alias("invalid"))


def append_log(rows: DataFrame, path: str, stamp: str = "logged_at") -> None:
    """Append rows with the time of writing."""
    rows.withColumn(stamp, F.current_timestamp()).write.mode("append").parquet(path)


def resume(cases: DataFrame, spark: SparkSession, done_path: str, key: str = "case_id") -> DataFrame:
    """The cases that an append-only result folder doesn't have yet."""
    if not path_exists(spark, done_path):
        return cases
    return cases.join(spark.read.json(done_path).select(key).distinct(), key, "left_anti")


def flatten_metrics(rows: DataFrame, column: str = "summary") -> DataFrame:
    """(metric, value) of a JSON object of numbers and texts."""
    return rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("metric", "value"))


def markdown_table(rows: DataFrame, columns: Sequence[str], limit: int | None = None) -> str:
    """A report of a few aggregated rows as a Markdown table; the first ``limit`` of them where one is given."""
    shown = rows.select(*columns) if limit is None else rows.select(*columns).limit(limit)
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown.toLocalIterator()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *body])
