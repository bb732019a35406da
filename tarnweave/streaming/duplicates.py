"""Duplicates of records in a stream: exact, normalised and close fingerprints, against all that was kept before.

State is a table of the kept records' hashes. A batch and all that counts of the
state are decided together: kept records aren't linked to each other (and equal texts have equal
fingerprints), so every link found has a record of the batch. Records of a batch come in the order of
their ids, batches in the order of their epochs, so records in the order of ids
give the same duplicates in any split into batches as all at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.operators import curation
from tarnweave.session import settle
from tarnweave.streaming.keyed import KeyedTable


def duplicates_sink(path: str, id_col: str = "conv_id", remember: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of records (id, and messages or the columns of ``curation.with_hashes``): decisions and kept records below ``path``, both or neither for a batch.

    ``remember``: how many epochs a kept record counts; None: for ever. A batch that
    is run again sees what it saw before, the records kept in earlier epochs.
    """
    kept, told = tables(path, id_col)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hashed = batch if {"exact_hash", "normalized_hash", "simhash"} <= set(batch.columns) else curation.with_hashes(batch)
        rows = hashed.select(F.col(id_col).alias("id"), "exact_hash", "normalized_hash", F.col("simhash").alias("fp"))
        rows = settle(rows.withColumn("seen", F.lit(epoch).cast("long")), "batch-records")
        try:
            before = kept.read(spark).where(F.col("seen") < epoch)
            before = before if remember is None else before.where(F.col("seen") >= epoch - remember)
            both = before.unionByName(rows)
        except ValueError:  # the first batch
            both = rows
        place = F.struct("seen", "id")
        recs = both.select(place.alias("at"), "exact_hash", "normalized_hash", F.col("fp").alias("simhash"))
        found = settle(curation.duplicates(recs, "at").where(F.col("at.seen") == epoch).select(F.col("at.id").alias("id"), F.col("duplicate_of.id").alias("duplicate_of"), "method"), "batch-duplicates")
        told.write(found.withColumnRenamed("id", id_col), epoch)
        kept.write(rows.join(found, "id", "left_anti"), epoch)
        spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("overwrite").json(f"{path}/commits/{epoch}")
        for table in (kept, told):
            table.merge_if_due(spark)

    return write


def tables(path: str, id_col: str = "conv_id") -> tuple[KeyedTable, KeyedTable]:
    """The kept records' hashes, and (id, duplicate_of, method) of the duplicates."""
    return KeyedTable(f"{path}/kept", ("id",), commits=f"{path}/commits"), KeyedTable(f"{path}/duplicates", (id_col,), commits=f"{path}/commits")
