"""Tables of one row a key that streams write: deltas by epoch over a base in buckets, merged from time to time.

A batch is a folder of its own, written again if the batch is, so a replay changes
nothing. A key's bucket is a hash of it; base and deltas are folders by bucket, and
a reader of some keys opens their buckets only. Every ``merge_every`` epochs those buckets that
deltas have touched are written anew, and a manifest, a row a bucket, that is there whole
or not at all, names what is the base and up to which epoch. Reading thus costs what the keys cost
and at most ``merge_every`` deltas.

Several tables can take a batch under one epoch: readers see an epoch once all of
them have it (``commits``), or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.sources.files import path_exists

BUCKETS, MERGE_EVERY = 16, 8
_MANIFEST = "seq long, bucket int, folder string, through long"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; of a missing one nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


@dataclass(frozen=True)
class KeyedTable:
    """One row a key below ``path``: of several in a batch the one of largest ``order``, of several batches the last.

    Without ``order`` a batch has one row a key, as aggregates in update mode give it.
    """

    path: str
    key: Sequence[str]
    order: str | Column | None = None
    buckets: int = BUCKETS
    merge_every: int = MERGE_EVERY
    #: A folder of epochs that all tables of a batch have; without one each delta counts at once.
    commits: str | None = None

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def manifest(self, spark: SparkSession) -> list[tuple[int, str, int]]:
        """(bucket, folder, through) of the base; the newest manifest counts."""
        if not path_exists(spark, f"{self.path}/manifest/*/*.json"):
            return []
        rows = spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/*/*.json").collect()  # a row a bucket and merge, of the last two merges
        newest = max((r["seq"] for r in rows), default=-1)
        return [(r["bucket"], r["folder"], r["through"]) for r in rows if r["seq"] == newest]

    def _epochs(self, spark: SparkSession, after: int) -> list[int]:
        found = [int(n.partition("=")[2]) for n in _children(spark, f"{self.path}/delta") if n.startswith("epoch=")]
        if self.commits:
            done = {int(n) for n in _children(spark, self.commits) if n.isdigit()}
            found = [e for e in found if e in done]
        return sorted(e for e in found if e > after)

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Take a batch, once: an epoch that is part of the base already isn't taken again."""
        spark = batch.sparkSession
        if taken := {"bucket", "epoch"} & {c.lower() for c in batch.columns}:
            raise ValueError(f"the table's own columns: {sorted(taken)}")
        if epoch <= max((t for _, _, t in self.manifest(spark)), default=-1):
            return
        rows = batch
        if self.order is not None:
            names = [c for c in batch.columns if c not in self.key]
            rows = batch.groupBy(*self.key).agg(F.max_by(F.struct(*names), self.order).alias("_r")).select(*self.key, "_r.*")
        self._bucketed(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/epoch={epoch}")
        if not self.commits:
            self.merge_if_due(spark)

    def merge_if_due(self, spark: SparkSession) -> None:
        base = self.manifest(spark)
        epochs = self._epochs(spark, max((t for _, _, t in base), default=-1))
        if len(epochs) >= self.merge_every:
            self._merge(spark, base, epochs)

    def _deltas(self, spark: SparkSession, epochs: list[int]) -> DataFrame | None:
        folders = (f"{self.path}/delta/epoch={e}" for e in epochs)
        paths = [p for p in folders if any(n.startswith("bucket=") for n in _children(spark, p))]
        return spark.read.option("basePath", f"{self.path}/delta").option("mergeSchema", True).parquet(*paths) if paths else None

    def _merge(self, spark: SparkSession, base: list[tuple[int, str, int]], epochs: list[int]) -> None:
        deltas = self._deltas(spark, epochs)
        touched = set() if deltas is None else {r["bucket"] for r in deltas.select("bucket").distinct().collect()}
        folder = f"{self.path}/base/{uuid.uuid4().hex}"
        if touched:
            self._bucketed(self._last(spark, [b for b in base if b[0] in touched], deltas)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        kept = [(b, f) for b, f, _ in base if b not in touched] + [(b, f"{folder}/bucket={b}") for b in sorted(touched)]
        if not kept:
            return
        # the old files stay until the next merge, for those who are reading them
        stale = set(_children(spark, f"{self.path}/manifest"))
        seq = 1 + max((int(n.partition("-")[0]) for n in stale if n[0].isdigit()), default=-1)
        rows = [(seq, b, f, epochs[-1]) for b, f in kept]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/{seq:012d}-{uuid.uuid4().hex}")
        self._sweep(spark, seq - 1, [f for _, f in kept], base)

    def _sweep(self, spark: SparkSession, before: int, folders: list[str], base: list[tuple[int, str, int]]) -> None:
        """Delete what neither the newest manifest nor the one before it names."""
        for n in _children(spark, f"{self.path}/manifest"):
            if n[0].isdigit() and int(n.partition("-")[0]) < before:
                _delete(spark, f"{self.path}/manifest/{n}")
        named = {f.rsplit("/", 2)[1] for f in [*folders, *(f for _, f, _ in base)]}
        for n in _children(spark, f"{self.path}/base"):
            if n not in named:
                _delete(spark, f"{self.path}/base/{n}")
        through = max((t for _, _, t in base), default=-1)
        for n in _children(spark, f"{self.path}/delta"):
            if n.startswith("epoch=") and int(n.partition("=")[2]) <= through:
                _delete(spark, f"{self.path}/delta/{n}")

    def _last(self, spark: SparkSession, base: list[tuple[int, str, int]], deltas: DataFrame | None) -> DataFrame:
        """The newest row of each key of the given buckets of the base and of the deltas."""
        rows = None
        if base:
            rows = spark.read.option("mergeSchema", True).parquet(*(f for _, f, _ in base)).drop("bucket").withColumn("epoch", F.lit(-1))
        if deltas is not None:
            own = deltas.drop("bucket")
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        names = [c for c in rows.columns if c not in (*self.key, "epoch")]
        if not names:
            return rows.select(*self.key).distinct()
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*names), "epoch").alias("_r")).select(*self.key, "_r.*")

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        """The table, or its rows of ``keys`` (which are few: their buckets are collected); an error if nothing was ever written."""
        base = self.manifest(spark)
        deltas = self._deltas(spark, self._epochs(spark, max((t for _, _, t in base), default=-1)))
        if keys is not None:
            wanted = {r["bucket"] for r in self._bucketed(keys.select(*self.key)).select("bucket").distinct().collect()}
            own = [b for b in base if b[0] in wanted]
            deltas = None if deltas is None else deltas.where(F.col("bucket").isin(*wanted) if wanted else F.lit(False))
            base = own or base[:1]
        if not base and deltas is None:
            raise ValueError(f"nothing was written to {self.path}")
        rows = self._last(spark, base, deltas)
        return rows if keys is None else rows.join(keys.select(*self.key).distinct(), list(self.key), "left_semi")


def keyed_sink(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of one table."""
    return table.write


def joint_sink(outputs: Mapping[str, tuple[KeyedTable, Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of several tables of one ``commits`` folder: each takes its step of the batch, then the epoch counts for all."""
    tables = [t for t, _ in outputs.values()]
    if len({t.commits for t in tables}) != 1 or tables[0].commits is None:
        raise ValueError("tables of one batch need one commits folder")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            for table, step in outputs.values():
                table.write(step(batch), epoch)
        finally:
            batch.unpersist()
        spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("overwrite").json(f"{tables[0].commits}/{epoch}")
        for table in tables:
            table.merge_if_due(spark)

    return write
