"""Leakage between corpora: equal texts by several keys, and short texts that occur inside long ones.

Defined cases: null and blank texts never leak; repeated rows are found
together; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions import text
from tarnweave.llm._arrow import flat_text
from tarnweave.session import broadcast_if_small, settle


def _keyed(df: DataFrame, id_col: str, body: str, key: Column) -> DataFrame:
    return df.where(~text.is_blank(F.col(body))).select(F.col(id_col).cast("string").alias("id"), F.sha2(key, 256).alias("key"))


def by_leading_text(evaluation: DataFrame, knowledge: DataFrame, eval_id: str = "item_id", kb_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(eval_id, kb_ids): texts equal in their first 2,000 characters but for case and white space; ids sorted."""
    own = _keyed(evaluation, eval_id, body, text.leading_key(F.col(body)))
    other = _keyed(knowledge, kb_id, body, text.leading_key(F.col(body))).join(own.select("key").distinct(), "key", "left_semi")
    paths = other.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("kb_ids"))
    return own.join(paths, "key").select(F.col("id").alias("eval_id"), "kb_ids")


def against_corpora(benchmark: DataFrame, corpora: Mapping[str, DataFrame], bench_id: str = "item_id", body: str = "text", least: int = 20) -> DataFrame:
    """(bench_id, method, corpus, n): exact and normalised matches; corpora have (id, text), shorter texts don't count."""
    keys = {"exact": text.folded_exact(F.col(body)), "normalized": text.folded_key(F.col(body))}
    both = lambda df, i: df.where((F.length(text.strip(F.col(body))) >= least)).select(F.col(i).cast("string").alias("id"), F.explode(F.create_map(*(x for k, c in keys.items() for x in (F.lit(k), F.unhex(F.sha2(c, 256)))))).alias("method", "key"))
    # hashed once for all corpora, as each is met with the keys and again with the ids
    own = settle(both(benchmark, bench_id), "leak-keys")
    asked = own.select("method", "key").distinct()
    found = None
    for name, df in corpora.items():
        hashes = both(df, "id").join(asked, ["method", "key"], "left_semi").groupBy("method", "key").agg(F.count("*").alias("n"))
        part = own.join(hashes, ["method", "key"]).select(F.col("id").alias("bench_id"), "method", F.lit(name).alias("corpus"), "n")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no corpus given")
    return found


def verdict(found: DataFrame) -> DataFrame:
    """(matches, status): pass if nothing was found."""
    return found.agg(F.count("*").alias("matches")).withColumn("status", F.when(F.col("matches") == 0, "pass").otherwise("fail"))


def _least_windows(width: int, span: int) -> Callable[[Column], Column]:
    """A function from bytes to the distinct hashes of windows that are the least of ``span`` neighbours."""

    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        weights = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(width)], np.uint64)
        flat, bounds = flat_text(column)
        counts, kept = [0], [np.zeros(0, np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            data, n = flat[lo:hi], int(hi - lo) - width + 1
            if n < span:
                counts.append(0)
                continue
            h = np.zeros(n, np.uint64)
            for k in range(width):
                h += data[k : k + n] * weights[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            low = h[: n - span + 1].copy()
            for k in range(1, span):
                np.minimum(low, h[k : k + len(low)], out=low)
            kept.append(np.unique(low).view(np.int64))
            counts.append(len(kept[-1]))
        # flat numbers, not one Python object each
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(np.concatenate(kept)))

    return run


def substrings(queries: DataFrame, chunks: DataFrame, query_id: str = "item_id", chunk_id: str = "doc_id", body: str = "text", least: int = 18, probe: int = 16) -> DataFrame:
    """(chunk_id, query_id): the first query (by id) of at least ``least`` characters whose text, without white space
    and case, occurs in the chunk's.

    Instead of meeting every query with every chunk, a query is represented by
    one window of ``probe`` bytes, that of least hash among the windows of its
    first ``least`` bytes. Of a chunk, the windows that are the least among as
    many neighbours are looked up; a chunk that contains the query has its window
    among them, and only pairs with an equal window are compared.
    """
    dense = lambda c: F.regexp_replace(F.lower(text.strip(c)), r"(?U)\s+", "")
    keys = _least_windows(probe, least - probe + 1)
    asked = queries.select(F.col(query_id).alias("qid"), dense(F.col(body)).alias("q")).where(F.length("q") >= least)
    asked = settle(asked.withColumn("key", F.get(keys(F.substring(F.encode("q", "UTF-8"), 1, least)), F.lit(0))), "leak-queries")
    rows = chunks.select(F.col(chunk_id).alias("cid"), dense(F.col(body)).alias("t")).where(F.length("t") >= least)
    probes = rows.select("cid", F.explode(keys(F.encode("t", "UTF-8"))).alias("key"))
    pairs = probes.join(broadcast_if_small(asked.select("qid", "key"), 48), "key").select("cid", "qid").distinct()
    texts = rows.select("cid", "t").join(pairs, "cid").join(broadcast_if_small(asked.select("qid", "q"), 4096), "qid")
    hit = texts.where(F.contains("t", F.col("q")))
    return hit.groupBy("cid").agg(F.min("qid").alias("qid")).select(F.col("cid").alias("chunk_id"), F.col("qid").alias("query_id"))
