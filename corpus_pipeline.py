"""The corpus pipeline: quality, lines, near-duplicates, benchmark passages, tokens.

Each stage takes all documents that the one before it kept, is written as
Parquet and read again. All but the last return the columns of ``documents``:

1. ``quality``: documents that the importance resampling doesn't select go;
2. ``lines``: lines go that repeat an earlier line, exactly or within one word;
   a document goes if no line with words is left of it;
3. ``near_duplicates``: one document of each SimHash component stays, that of the
   smallest id;
4. ``decontamination``: documents go of which a twentieth or more lies in
   benchmark passages;
5. ``tokens``: each text as token ids, with a column that says whether they decode
   to the same text.

SQL can't express hashed sampling, components or BPE merges, so ``ORACLE_SQL`` is
None and the tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm import bpe, decontaminate, linededup, quality, simhash
from tarnweave.llm._arrow import small_batches
from tarnweave.llm.queries import vocabulary
from tarnweave.session import settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = small_batches(docs)
    return quality.keep_selected(docs, table(docs.sparkSession, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(small_batches(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenise(small_batches(docs), vocabulary()).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
