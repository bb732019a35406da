"""Batch retrieval: BM25 postings, exact vector search, rank fusion, policy filters, re-ranking.

Queries are rows (query_id, query, ...), and all queries of a batch are answered
by one plan. Candidates are long rows (query_id, chunk_id, scores, ranks), windows
by query do what depends on a query's other candidates.

Defined cases: null texts have no tokens; a query without matches has no rows; ties
go to the smaller chunk id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.functions import numbers, text
from tarnweave.operators import lexicon as lexicons
from tarnweave.session import broadcast_if_small, settle

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Entries of a lexicon that every query meets in one row.
LISTED = 1_000
#: Pairs of a query's word and a posting that are added up without bounds.
FEW_POSTINGS = 50_000_000
#: Pairs of a query and a word, or bytes of query vectors, that each task holds while texts or vectors pass by once.
HELD_PAIRS, HELD_BYTES = 100_000, 32 << 20
#: Scores that a task works on at once.
SCORES = 1 << 20


# --- the lexical index ------------------------------------------------------


@dataclass
class LexicalIndex:
    """postings (term, doc_id, tf), docs (doc_id, dl) and terms (term, df, idf), with the mean and the least length.

    An index of texts also has their tokens (doc_id, tokens); its postings and docs are plans that
    nothing is written for until they are asked for.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    n_docs: int
    mean_length: float
    least_length: int
    tokens: DataFrame | None = None


def build_index(chunks: DataFrame, id_col: str = "chunk_id", body: str = "content") -> LexicalIndex:
    """The index of all chunks, whose ids are unique: one pass counts the texts of each word, so that a row a word and task is shuffled."""
    tokens = chunks.select(F.col(id_col).alias("doc_id"), text.lexical_tokens(F.col(body)).alias("tokens"))
    docs = tokens.select("doc_id", F.size("tokens").alias("dl"))
    postings = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    # the row without a term stands for the text itself
    words = tokens.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tokens"))).alias("term"))
    seen = settle(words.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"), F.min("dl").alias("least")), "index-words")
    n, total, least = seen.where("term is null").agg(F.sum("df"), F.sum("total"), F.min("least")).first()
    return _with_terms(postings, docs, seen.where("term is not null").select("term", "df"), n or 0, (total or 0) / (n or 1), least, tokens)


def _with_terms(postings: DataFrame, docs: DataFrame, df: DataFrame, n: int, mean: float | None, least: int | None, tokens: DataFrame | None = None) -> LexicalIndex:
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = settle(df.withColumn("raw", raw), "index-terms")
    mean_idf = terms.agg(F.avg("raw")).first()[0] or 0.0
    # a word of more than half of the texts weighs a share of the mean, not less than nothing
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * mean_idf)).otherwise(F.col("raw"))
    return LexicalIndex(postings, docs, terms.select("term", "df", idf.alias("idf")), n, mean or 0.0, least or 0, tokens)


def save_index(index: LexicalIndex, path: str) -> dict:
    """Write the index below ``path``; what a health check compares is returned."""
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    return {"status": "ready", "documents": index.n_docs, "average_tokens": round(index.mean_length, 2)}


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    postings, docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
    n, mean, least = docs.agg(F.count("*"), F.avg("dl"), F.min("dl")).first()
    return _with_terms(postings, docs, postings.groupBy("term").agg(F.count("*").alias("df")), n, mean, least)


def index_healthy(spark: SparkSession, path: str, expected: int) -> tuple[bool, str]:
    n = spark.read.parquet(f"{path}/docs").count()
    return (True, "ok") if n == expected else (False, f"expected {expected} documents, found {n}")


def bm25(index: LexicalIndex, queries: DataFrame, k: int = 5, id_col: str = "query_id", query: str = "query", seeds: int = 64, few: int = FEW_POSTINGS, held: int = HELD_PAIRS) -> DataFrame:
    """(query_id, doc_id, raw_score, score, rank): the k best of each query; score is the share of the query's best.

    Where no score of a query is above zero, the number of its words that a
    text has counts instead.

    Of an index with tokens, up to ``held`` pairs of a query and a word are held by every task, and the texts pass by
    once: a task adds up the scores of some texts at a time and lets each query's best go on. Of others,
    up to ``few`` pairs of a query's word and a posting are simply added up. Beyond that,
    postings of common words are met by few texts only: a query's rarest words (those
    that ``seeds`` times k postings reach) give k texts and with them a score that
    the k best have at least. Words that couldn't make up that score together, whatever the
    text, bring in no text by themselves: they are looked up for the texts that the
    other words bring in and that they could still lift to that score. The rows are those of a full search.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.explode(text.lexical_tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    relative = lambda dl: F.lit(1 - B) + F.lit(B / max(index.mean_length, 1e-9)) * dl
    saturated = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * relative(dl))
    asked = settle(asked.join(index.terms, "term").withColumn("weight", F.col("qtf") * F.col("idf")), "query-words")
    if index.tokens is not None and asked.limit(held + 1).count() <= held:
        scored = _added(_passing(index, asked, k))
    else:
        scored = _joined(index, asked, saturated, k, seeds, few)
    flat = F.max("bm25").over(Window.partitionBy("query_id")) <= 0
    scored = scored.withColumn("raw_score", F.when(flat, F.col("overlap").cast("double")).otherwise(F.col("bm25")))
    return top_k(scored.where("raw_score > 0"), "raw_score", k).select("query_id", "doc_id", "raw_score", share_of_best("raw_score").alias("score"), "rank")


def _joined(index: LexicalIndex, asked: DataFrame, saturated: Callable, k: int, seeds: int, few: int) -> DataFrame:
    """Scores by joins of the queries' words with their postings."""
    postings = settle(index.postings.join(asked.select("term").distinct(), "term", "left_semi"), "index-postings")
    docs = settle(index.docs, "index-docs")
    # a term's largest tf bounds what a text can gain by it
    asked = asked.join(postings.groupBy("term").agg(F.max("tf").alias("most")), "term")
    asked = asked.withColumn("bound", F.col("weight") * saturated(F.col("most"), F.lit(index.least_length)))
    rising = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    asked = settle(asked.withColumn("seed", F.coalesce(F.sum("df").over(rising), F.lit(0)) < seeds * k), "query-terms")
    gain = F.sum(F.col("weight") * saturated(F.col("tf"), F.col("dl")))

    def found(terms: DataFrame, by: str = "term") -> DataFrame:
        hits = postings.join(broadcast_if_small(terms, 96), ["term"] if by == "term" else ["term", by]).join(docs, "doc_id")
        return hits.groupBy("query_id", "doc_id").agg(gain.alias("gain"), F.count("*").alias("overlap"))

    met = asked.agg(F.sum("df")).first()[0] or 0
    return _added(found(asked.select("query_id", "term", "weight"))) if met <= few else _added(_pruned(asked, found, k))


def _passing(index: LexicalIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, gain, overlap) of texts that may be among a query's k best: those of each few texts."""
    pairs = asked.select("query_id", "term", "weight").collect()  # at most as many as may be held
    ids = list({r["query_id"]: None for r in pairs})
    terms = list({r["term"]: None for r in pairs})
    place, spot = ({v: i for i, v in enumerate(vs)} for vs in (ids, terms))
    of_term = np.array([spot[r["term"]] for r in pairs], np.int64)
    order = np.argsort(of_term, kind="stable")
    asking = np.array([place[r["query_id"]] for r in pairs], np.int64)[order]
    weight = np.array([r["weight"] for r in pairs], np.float64)[order]
    starts = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    mean = max(index.mean_length, 1e-9)
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", index.tokens.schema["doc_id"].dataType), T.StructField("gain", T.DoubleType()), T.StructField("overlap", T.LongType())])

    def scored(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Places of queries and texts, gains and overlaps; ``doc`` and ``length`` are of these texts only."""
        n_of = starts[term + 1] - starts[term]
        at = np.repeat(starts[term] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B / mean * length[doc]))
        cell = asking[at] * len(length) + np.repeat(doc, n_of)
        size = len(ids) * len(length)
        gain = np.bincount(cell, weight[at] * np.repeat(share, n_of), size).reshape(len(ids), -1)
        overlap = np.bincount(cell, minlength=size).reshape(len(ids), -1)
        # where no text gains, the words that it has count
        value = np.where((gain > 5e-10).any(1)[:, None], gain, overlap)
        least = np.partition(value, -k, 1)[:, -k] if len(length) > k else np.zeros(len(ids))
        q, d = np.nonzero((overlap > 0) & (value > 0) & (value >= least[:, None] - 1e-8))  # rounding can make ties
        yield q, d, gain[q, d], overlap[q, d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = pa.array(terms, pa.string()), pa.array(ids)
        step = max(1, SCORES // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, len(batch), step):
                docs, words = batch.column(0).slice(lo, step), batch.column(1).slice(lo, step)
                length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                term = pc.index_in(words.flatten(), known)
                has = pc.is_valid(term).to_numpy(zero_copy_only=False)
                key, tf = np.unique(np.repeat(np.arange(len(docs)), length)[has] * len(terms) + term.drop_null().to_numpy(), return_counts=True)
                for q, d, gain, overlap in scored(key // len(terms), key % len(terms), tf, length):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), docs.take(pa.array(d)), pa.array(gain), pa.array(overlap)], names=schema.names)

    if not pairs:
        return asked.sparkSession.createDataFrame([], schema)
    return index.tokens.where("doc_id is not null and size(tokens) > 0").mapInArrow(run, schema)


def _added(gains: DataFrame) -> DataFrame:
    return gains.groupBy("query_id", "doc_id").agg(F.round(F.sum("gain"), 9).alias("bm25"), F.sum("overlap").alias("overlap"))


def _pruned(asked: DataFrame, found: Callable[..., DataFrame], k: int) -> DataFrame:
    """(query_id, doc_id, gain, overlap), to be added up, of all texts that may be among a query's k best."""
    # a score of k texts by some of the words; no lower limit where a word may weigh less than nothing
    least = top_k(found(asked.where("seed").select("query_id", "term", "weight")), "gain", k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("gain")).alias("least"))
    free = asked.groupBy("query_id").agg((F.min("weight") >= 0).alias("free"))
    limits = free.join(least, "query_id", "left").select("query_id", F.when(F.col("free"), F.col("least") - 1e-6).alias("least"))
    upward = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.join(limits, "query_id").withColumn("late", F.coalesce(F.sum("bound").over(upward) < F.col("least"), F.lit(False)))
    asked = settle(asked.withColumn("rest", F.sum(F.when(F.col("late"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy("query_id"))), "query-terms")
    near = found(asked.where("not late").select("query_id", "term", "weight")).join(asked.select("query_id", "least", "rest").distinct(), "query_id")
    near = settle(near.where(F.col("least").isNull() | (F.col("gain") + F.col("rest") >= F.col("least"))).select("query_id", "doc_id", "gain", "overlap"), "near-texts")
    wanted = settle(near.select("query_id", "doc_id").join(asked.where("late").select("query_id", "term", "weight"), "query_id"), "late-words")
    more = found(wanted, "doc_id")
    return near.union(more)


def top_k(rows: DataFrame, score: str, k: int, by: Sequence[str] = ("query_id",), tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group, with rank from 1; Spark cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_of_best(score: str, by: str = "query_id", digits: int = 4) -> Column:
    return F.round(F.col(score) / F.greatest(F.max(score).over(Window.partitionBy(by)), F.lit(1e-6)), digits)


def min_max(score: str, by: str = "query_id") -> Column:
    """The score's place between the least and the best of its group; 1 where they are the same."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def hits_score(hits: Column) -> Column:
    """A score between 0 and 1 that grows with the number of words found."""
    return 1 - F.exp(-hits / 4)


# --- vectors ----------------------------------------------------------------


def hashed_embedding(c: Column, dimensions: int = 384) -> Column:
    """A unit vector of signed hashed tokens (BLAKE2b), rounded to 6 digits; all zeros for a text without tokens."""
    size = max(dimensions, 64)

    @F.arrow_udf("array<double>")
    def embed(tokens: pa.Array) -> pa.Array:
        import hashlib

        rows = []
        for words in tokens.to_pylist():
            v = np.zeros(size)
            for w in words or ():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % size] += (1.0 if h[4] % 2 == 0 else -1.0) * (1.0 + min(len(w), 4) * 0.05)
            n = float(np.sqrt((v * v).sum()))
            rows.append([round(x / n, 6) for x in v.tolist()] if n else v.tolist())
        return pa.array(rows, pa.list_(pa.float64()))

    return embed(text.lexical_tokens(c))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, measure: str = "dot", id_col: str = "vec_id", vector: str = "embedding", partition: str | None = None, block: int = 1024, held: int = HELD_BYTES) -> DataFrame:
    """(query_id, doc_id, score, rank[, partition]): the k nearest vectors of each query row, exactly.

    ``queries`` is a stated set (columns as ``vectors``). Up to a block of them, of at most ``held`` bytes, is held by
    every task, and vectors pass by without being shuffled. Beyond that, queries are dealt by hash to
    blocks of about ``block`` rows, vectors to blocks of four times as many, and each
    pair of blocks meets in one group: its queries are held, its vectors pass by in
    slices, and k rows a query and slice go on. Nothing goes through the driver but
    two counts. ``measure``: ``dot`` (above zero only) or ``l2`` (score 1 / (1 + distance)).
    A row isn't its own neighbour. With ``partition``, ranks are by query and that
    column. Vectors that are null or hold null or non-finite components take no
    part, and those of another length don't meet a query; of query rows that repeat
    an id the one of the least vector asks.
    """
    extra = [partition] if partition else []
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, doc_id {kind}, score double" + ", part string" * bool(extra)
    part = F.col(partition).cast("string") if partition else F.lit(None).cast("string")
    usable = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is above infinity
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), part.alias("part")).where(usable)
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    asked = settle(asked.groupBy("id").agg(F.min("v").alias("v")), "query-vectors")
    n, values = asked.select(F.size("v").alias("n")).agg(F.count("*"), F.sum("n")).first()
    few = n <= block and 8 * (values or 0) <= held
    held_ids, held_lists = map(list, zip(*asked.collect(), strict=True)) if few and n else ([], [])
    n_asked, n_rows = (F.lit(1), F.lit(1)) if few else (F.lit(max(1, -(-df.count() // size))) for df, size in ((asked, block), (rows, 4 * block)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    holding = asked.select(dealt(n_asked, "id").alias("qb"), every(n_rows).alias("vb"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("string").alias("part"))
    place = (F.lit(0).alias("qb"), F.lit(0).alias("vb")) if few else (every(n_asked).alias("qb"), dealt(n_rows, "id", "v").alias("vb"))
    passing = rows.select(*place, F.lit(1).alias("kind"), "id", "v", "part")

    def scored(q_ids: list, q: np.ndarray, ids: list, x: np.ndarray, parts: np.ndarray) -> list[tuple]:
        score = q @ x.T
        if measure == "l2":
            score = 1 / (1 + np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * score + (x * x).sum(1)[None, :], 0)))
        out: list[tuple] = []
        for p in set(parts):
            inside = np.flatnonzero(np.array([o == p for o in parts]))
            for i, qid in enumerate(q_ids):
                s = score[i, inside]
                best = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
                least = s[best].min() - 2e-6 if len(s) > k + 1 else -np.inf  # rounding can make ties
                for j in np.flatnonzero(s >= least):
                    if ids[inside[j]] != qid and (measure != "dot" or s[j] > 0):
                        out.append((qid, ids[inside[j]], float(s[j]), *([p] if extra else [])))
        return out

    def by_length(ids: list, lists: list[list]) -> dict[int, tuple[list, np.ndarray, list[int]]]:
        of: dict[int, list[int]] = {}
        for at, v in enumerate(lists):
            of.setdefault(len(v), []).append(at)
        return {n: ([ids[at] for at in ats], np.array([lists[at] for at in ats], np.float64).reshape(len(ats), n), ats) for n, ats in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, lists, asking = ((0, 0), [], [], by_length(held_ids, held_lists)) if few else (None, [], [], None)
        names = ["query_id", "doc_id", "score", *(["part"] if extra else [])]
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                types = [batch.column(3).type, batch.column(3).type, pa.float64(), *([pa.string()] if extra else [])]
                marks = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
                cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                    if key != tuple(marks[lo, :2]):
                        key, ids, lists, asking = tuple(marks[lo, :2]), [], [], None
                    own_ids, own = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (3, 4))
                    if marks[lo, 2] == 0:
                        ids, lists = ids + own_ids, lists + own
                        continue
                    asking = by_length(ids, lists) if asking is None else asking
                    parts = batch.column(5).slice(lo, hi - lo).to_pylist()
                    for n, (found_ids, x, ats) in by_length(own_ids, own).items():
                        out = scored(*asking[n][:2], found_ids, x, [parts[a] for a in ats]) if n in asking else []
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    met = passing if few else holding.union(passing).repartition("qb", "vb").sortWithinPartitions("qb", "vb", "kind")
    found = met.mapInArrow(run, schema).withColumn("score", F.round("score", 6))
    best = top_k(found, "score", k, ("query_id", *(["part"] if extra else [])))
    return best.withColumnRenamed("part", partition) if partition else best


# --- fusion -----------------------------------------------------------------


def merge_candidates(found: DataFrame) -> DataFrame:
    """One row a query and chunk: best scores, least ranks, the sources that found it.

    ``found``: (query_id, chunk_id, source, rank, score), source ``bm25`` or ``dense``.
    """
    of = lambda source, name: F.when(F.col("source") == source, F.col(name))
    return found.where("chunk_id is not null and chunk_id <> ''" if dict(found.dtypes)["chunk_id"] == "string" else "chunk_id is not null").groupBy("query_id", "chunk_id").agg(
        F.coalesce(F.max(of("dense", "score")), F.lit(0.0)).alias("vector_score"), F.coalesce(F.max(of("bm25", "score")), F.lit(0.0)).alias("keyword_score"),
        F.min(of("dense", "rank")).alias("dense_rank"), F.min(of("bm25", "rank")).alias("bm25_rank"), F.array_sort(F.collect_set("source")).alias("retrieval_sources"),
    )


def with_rrf(candidates: DataFrame, k: int = 60) -> DataFrame:
    """``candidates`` with rrf_score (the sum of 1 / (k + rank)) and rrf_score_norm, its share of the query's best."""
    part = lambda rank: F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))
    raw = part("dense_rank") + part("bm25_rank")
    rows = candidates.withColumn("_raw", raw).withColumn("rrf_score", F.round("_raw", 8))
    best = F.greatest(F.max("_raw").over(Window.partitionBy("query_id")), F.lit(1e-9))
    return rows.withColumn("rrf_score_norm", F.round(F.col("rrf_score") / best, 4)).drop("_raw")


def with_fusion(candidates: DataFrame, rrf_weight: float = 0.7) -> DataFrame:
    """fusion_score, which replaces rerank_score: rank fusion and the share of the query's best re-ranking."""
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    share = F.col("rerank_score") / F.greatest(F.when(best == 0, 1.0).otherwise(best), F.lit(1e-9))
    fused = F.round(rrf_weight * F.col("rrf_score_norm") + (1 - rrf_weight) * share, 4)
    return candidates.withColumn("fusion_score", fused).withColumn("rerank_score", F.col("fusion_score"))


def overlap_share(query: Column, *fields: Column) -> Column:
    """The share of the query's words that occur in the fields."""
    terms = text.query_terms(query)
    hay = F.lower(F.concat_ws(" ", *(text.text_or_empty(f) for f in fields)))
    return F.least(F.lit(1.0), F.size(F.filter(terms, lambda t: F.contains(hay, t))) / F.greatest(F.size(terms), F.lit(1)))


def with_rerank(candidates: DataFrame, query: str = "query", title: str = "title", section: str = "section", content: str = "content") -> DataFrame:
    """semantic_score and rerank_score from keyword, vector and word overlap."""
    over = overlap_share(F.col(query), F.col(title), F.col(section), F.col(content))
    rows = candidates.withColumn("_o", over)
    score = F.col("vector_score") * 0.2 + F.col("keyword_score") * 0.55 + F.col("_o") * 0.25
    return rows.withColumns({"semantic_score": F.round(F.greatest("vector_score", "keyword_score", "_o"), 4), "rerank_score": F.round(score, 4)}).drop("_o")


def field_score(candidate: Column, desired: Column) -> Column:
    """1 for a common value, 0.35 for a general candidate, 0.55 for one within another, else 0. Both are arrays in lower case."""
    general = F.array(*map(F.lit, ("general", "neutral", "all", "universal")))
    inside = F.exists(desired, lambda d: F.exists(candidate, lambda c: (F.length(d) >= 4) & (F.length(c) >= 4) & (F.contains(c, d) | F.contains(d, c))))
    blank = (F.coalesce(F.size(desired), F.lit(0)) == 0) | (F.coalesce(F.size(candidate), F.lit(0)) == 0)
    return F.when(blank, 0.0).when(F.arrays_overlap(desired, candidate), 1.0).when(F.arrays_overlap(candidate, general), 0.35).when(inside, 0.55).otherwise(0.0)


def value_set(c: Column) -> Column:
    """The distinct lower-case values of a text that commas, bars, semicolons or blanks part."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text.strip(c)), r"[,，/|;；\s]+"), text.strip), lambda v: v != ""))


# Levels of risk and how well a text of one level serves another.
HIGH, MEDIUM, LOW = ("high", "crisis", "self_harm", "suicide", "harm_to_others"), ("medium", "monitoring"), ("low", "none", "general")


def risk_compatibility(candidate: Column, desired: Column) -> Column:
    """From 0.05 to 1; where several values are given the least by order counts."""
    one = lambda c: F.coalesce(F.array_min(value_set(c)), F.lit("low"))
    c, d = one(candidate), one(desired)
    return (
        F.when(d.isin(*HIGH), F.when(c.isin(*HIGH), 1.0).when(c.isin(*MEDIUM), 0.65).otherwise(0.25))
        .when(d.isin(*MEDIUM) & c.isin(*MEDIUM), 1.0).when(d.isin(*MEDIUM) & c.isin(*HIGH), 0.3).when(d.isin(*MEDIUM) & c.isin(*LOW), 0.7)
        .when(c.isin(*HIGH), 0.05).when(c.isin(*MEDIUM), 0.55).otherwise(1.0)
    )


#: Weights of meaning, emotion, cause, strategy and risk.
WEIGHTS = (0.55, 0.15, 0.15, 0.10, 0.05)


def with_context_rerank(candidates: DataFrame, context: Mapping[str, str], query: str = "query", weights: Sequence[float] = WEIGHTS, title: str = "title", section: str = "section", content: str = "content") -> DataFrame:
    """The five scores, psychological_score and rerank_score against a context of emotion, cause, strategy and risk_level.

    Where the context says nothing, the best of the three kinds of likeness counts alone.
    """
    ignored = {"emotion": ("", "neutral", "unknown"), "cause": ("", "general", "unknown"), "strategy": ("", "supportive_listening", "unknown"), "risk_level": ("", "low", "unknown")}
    semantic = F.greatest(F.col("vector_score"), F.col("keyword_score"), overlap_share(F.col(query), F.col(title), F.col(section), F.col(content)))
    rows = candidates.withColumn("_s", semantic)
    if not any(str(context.get(k, "")).strip().lower() not in v for k, v in ignored.items()):
        zeros = {f"{n}_score": F.lit(0.0) for n in ("emotion", "cause", "strategy", "risk", "psychological")}
        return rows.withColumns({"semantic_score": F.round("_s", 4), **zeros, "rerank_score": F.round("_s", 4)}).drop("_s")
    has = lambda n: F.col(n) if n in candidates.columns else F.lit(None).cast("string")
    own = {n: field_score(value_set(has(n)), value_set(F.lit(context.get(n, "")))) for n in ("emotion", "cause", "strategy")}
    own["risk"] = risk_compatibility(has("risk_level"), F.lit(context.get("risk_level", "low")))
    mixed = reduce(lambda a, b: a + b, (own[n] * w for n, w in zip(own, weights[1:], strict=True)))
    score = (F.col("_s") * weights[0] + mixed) / (sum(weights) or 1.0)
    scores = {f"{n}_score": F.round(v, 4) for n, v in own.items()}
    return rows.withColumns({"semantic_score": F.round("_s", 4), **scores, "psychological_score": F.round(mixed / max(sum(weights[1:]), 1e-6), 4), "rerank_score": F.round(score, 4)}).drop("_s")


# --- tags and boosts --------------------------------------------------------

# Groups of people that texts for adults serve, and groups that ask for texts of their own.
ADULT_GROUPS = ("adults", "young_adults", "university_students", "workers", "caregivers", "family_members_supporting_others", "people_experiencing_grief", "people_exposed_to_trauma")
BROAD_ADULT = ("adults", "young_adults", "university_students")
SPECIFIC_GROUPS = ("children", "adolescents", "older_adults", "pregnant_people", "postpartum_people", "parents", "caregivers", "workers", "university_students", "people_experiencing_grief")


def tag_keys(tags: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), text.metadata_key), lambda t: t != "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def population_compatible(desired: Column, candidate: Column) -> Column:
    """Whether texts for ``candidate`` serve ``desired``; true if nothing is desired, false if the text says nothing."""
    d, c = tag_keys(desired), tag_keys(candidate)
    has = lambda arr, *names: F.arrays_overlap(arr, _strings(names))
    served = (
        F.arrays_overlap(d, c)
        | ((F.size(F.array_except(d, _strings(ADULT_GROUPS))) == 0) & has(c, *BROAD_ADULT))
        | (F.array_contains(d, "parents") & has(c, "parents", "caregivers", "adults"))
        | (F.array_contains(d, "caregivers") & has(c, "caregivers", "family_members_supporting_others", "adults"))
    )
    return F.when(F.size(d) == 0, True).when(F.size(c) == 0, False).otherwise(served)


def population_mismatch(desired: Column, candidate: Column) -> Column:
    """Whether a group with needs of its own is desired, and the text is for others and not for adults at large."""
    d, c = tag_keys(desired), tag_keys(candidate)
    return (F.size(d) > 0) & (F.size(c) > 0) & ~population_compatible(desired, candidate) & F.arrays_overlap(d, _strings(SPECIFIC_GROUPS)) & ~F.arrays_overlap(c, _strings(BROAD_ADULT))


def topic_strength(candidate: Column, primary: Column, desired: Column) -> Column:
    """1.25 for a topic that goes with the first one asked for, 1 with any, 0.55 for a name within a name, -0.25 for none of these, 0 if none is asked for."""
    inside = F.exists(desired, lambda d: F.exists(candidate, lambda c: (F.length(d) >= 5) & (F.length(c) >= 5) & (F.contains(c, d) | F.contains(d, c))))
    return (
        F.when(F.size(desired) == 0, 0.0).when(F.size(candidate) == 0, -0.25).when(F.arrays_overlap(candidate, primary), 1.25)
        .when(F.arrays_overlap(candidate, desired), 1.0).when(inside, 0.55).otherwise(-0.25)
    )


def with_boosts(candidates: DataFrame) -> DataFrame:
    """rerank_score moved by language, population and topic, within 0 and 1.

    Needs contains_cjk, populations, primary_topics and desired_topics of the
    query, and language, population_tags and topic_tags of the chunk.
    """
    c = F.col
    strength = topic_strength(tag_keys(c("topic_tags")), c("primary_topics"), c("desired_topics"))
    wanted = F.size(c("populations")) > 0
    people = F.when(wanted & population_compatible(c("populations"), c("population_tags")), 0.03).when(population_mismatch(c("populations"), c("population_tags")), -0.04).otherwise(0.0)
    topic = F.when(strength >= 1.2, 0.09).when(strength >= 1.0, 0.06).when(strength > 0, 0.03).when(strength < 0, -0.025).otherwise(0.0)
    boost = F.when(c("contains_cjk") & F.lower("language").startswith("zh"), 0.03).otherwise(0.0) + people + topic
    rows = candidates.withColumn("v2_context_boost", F.round(boost, 4))
    moved = F.round(numbers.clamp(c("rerank_score") + boost, 0.0, 1.0), 4)
    return rows.withColumn("rerank_score", F.when(F.col("v2_context_boost") == 0, F.col("rerank_score")).otherwise(moved))


def keep_population_matches(candidates: DataFrame) -> DataFrame:
    """Drops mismatches of a query that has at least one compatible candidate."""
    fits = population_compatible(F.col("populations"), F.col("population_tags"))
    some = F.max(fits.cast("int")).over(Window.partitionBy("query_id")) == 1
    bad = population_mismatch(F.col("populations"), F.col("population_tags"))
    rows = candidates.withColumn("_some", some)
    return rows.where((F.size("populations") == 0) | ~F.col("_some") | ~bad).drop("_some")


def dedupe_ranked(candidates: DataFrame, score: str = "rerank_score") -> DataFrame:
    """The best candidate of each content hash (without one: of the first 500 characters)."""
    body = F.substring(F.regexp_replace(F.lower(text.strip(F.col("content"))), r"\s+", " "), 1, 500)
    key = F.when(~text.is_blank(F.col("content_sha256")), F.col("content_sha256")).when(body != "", body).otherwise(F.concat(F.lit("\x00"), F.col("chunk_id").cast("string")))
    order = Window.partitionBy("query_id", "_key").orderBy(F.desc(score), "chunk_id")
    return candidates.withColumn("_key", key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_key", "_n")


# --- gates ------------------------------------------------------------------

# Where ordinary users are served from.
USER_COLLECTIONS, USER_MODES, USER_SCOPES = ("interventions", "professional_knowledge", "campus_support"), ("direct_user_support",), ("", "normal", "general")


def wants_safety(collections: Sequence[str] = (), filters: Mapping[str, Sequence[str]] | None = None) -> bool:
    asked = {v for k in ("target_collection", "collection", "collections", "use_mode", "risk_scope") for v in (filters or {}).get(k, ())}
    return "safety" in collections or bool(asked & {"safety", "safety_only", "safety_route_only"})


def wants_psychoeducation(collections: Sequence[str] = (), filters: Mapping[str, Sequence[str]] | None = None) -> bool:
    asked = {v for k in ("target_collection", "collection", "collections", "use_mode") for v in (filters or {}).get(k, ())}
    return "psychoeducation_only" in asked and "professional_knowledge" in {*collections, *asked}


@dataclass(frozen=True)
class Boundary:
    """Terms that take a query out of ordinary retrieval."""

    safety: tuple[str, ...]
    medication: tuple[str, ...]
    diagnosis: tuple[str, ...]
    instructions: tuple[str, ...]
    harm: str = r"(伤害|危险|违法|中毒|过量|昏迷|weapon|poison|overdose|harm)"

    def reason(self, query: Column, collections: Sequence[str] = (), filters: Mapping[str, Sequence[str]] | None = None) -> Column:
        """Why a query isn't answered, or an empty text."""
        if wants_safety(collections, filters):
            return F.lit("")
        low = F.lower(text.strip(query))
        diagnosis = F.lit("") if wants_psychoeducation(collections, filters) else F.lit("diagnosis_out_of_scope")
        return (
            F.when(text.contains_any(low, self.safety), "safety_route_required")
            .when(text.contains_any(low, self.medication), "medication_or_dosage_out_of_scope")
            .when(text.contains_any(low, self.diagnosis), diagnosis)
            .when(text.contains_any(low, self.instructions) & low.rlike(self.harm), "dangerous_instruction_out_of_scope")
            .otherwise("")
        )


def user_facing(collections: Sequence[str] | None = None, filters: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Whether a chunk may be shown on this route."""
    filters, allowed = filters or {}, list(collections or USER_COLLECTIONS)
    c = lambda n, d: F.when(text.is_blank(F.col(n)), d).otherwise(F.col(n))
    collection, mode, scope = c("target_collection", ""), c("use_mode", "direct_user_support"), c("risk_scope", "normal")
    flag = lambda n, d: F.coalesce(F.col(n), F.lit(d))
    served = collection.isin(*allowed) & collection.isin(*USER_COLLECTIONS) & scope.isin(*USER_SCOPES) & ~flag("clinical_only", False)
    guarded = (collection == "safety") | (mode == "safety_only") | (scope == "safety_route_only")
    opened = collection.isin(*allowed) & (mode == "safety_only") & F.lit("safety_route_only" in filters.get("risk_scope", ()))
    rest = served & mode.isin(*USER_MODES) & flag("user_facing", True)
    if "psychoeducation_only" in filters.get("use_mode", ()):
        rest = F.when(mode == "psychoeducation_only", served).otherwise(rest)
    return ~flag("exclude_from_index", False) & F.when(guarded, opened).otherwise(rest)


def review_allowed(status: Column, staging: bool = True, mode: str = "staging") -> Column:
    low = F.lower(text.strip(status))
    approved = low.isin("approved", "reviewed")
    return approved if index_mode(mode) == "production" or not staging else approved | ~low.isin("rejected", "blocked")


def index_mode(mode: str | None = None) -> str:
    return "production" if (mode or "staging").strip().lower() in {"production", "prod", "approved"} else "staging"


def eligible_for_index(mode: str = "staging") -> Column:
    low = F.lower(text.strip(F.col("review_status")))
    status = low.isin("approved", "reviewed") if index_mode(mode) == "production" else ~low.isin("rejected", "blocked")
    return ~F.coalesce(F.col("exclude_from_index"), F.lit(False)) & status & ~text.is_blank(F.col("content"))


def matches_filter(filters: Mapping[str, Sequence[str]]) -> Column:
    """All filters that say something: plain columns by value, tags by overlap, populations by compatibility.

    Literals on plain columns reach the scan, and partition columns prune it.
    """
    names = {"collection": "target_collection", "collections": "target_collection", "topic": "topic_tags", "topics": "topic_tags", "population": "population_tags", "populations": "population_tags", "life_stage": "life_stage_tags", "life_stages": "life_stage_tags"}

    def one(key: str, values: Sequence[str]) -> Column:
        name = names.get(key, key)
        if name == "population_tags":
            return population_compatible(_strings(values), F.col(name))
        if name in ("target_collection", "use_mode", "risk_scope", "review_status", "language", "source_id"):
            return F.coalesce(F.col(name), F.lit("")).isin(*values)
        return F.coalesce(F.arrays_overlap(F.col(name), _strings(values)), F.lit(False))

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in filters.items() if v), F.lit(True))


def term_support(terms: Column, *fields: Column) -> Column:
    """Whether a part of at least three letters of one of the terms occurs in the fields; true without terms."""
    parts = F.filter(F.flatten(F.transform(terms, lambda t: F.split(F.lower(t), r"[\s,/;，；]+"))), lambda p: F.length(p) >= 3)
    hay = F.lower(F.concat_ws(" ", *fields))
    return (F.size(terms) == 0) | F.exists(parts, lambda p: F.contains(hay, p))


def score_gate(min_relevance: float = 0.26, min_vector: float = 0.46) -> Column:
    return (F.col("rerank_score") >= min_relevance) & ((F.col("keyword_score") > 0) | (F.col("vector_score") >= min_vector))


# --- rewriting --------------------------------------------------------------


def rewrite_queries(queries: DataFrame, lexicon: DataFrame, populations: DataFrame | None = None, compatible: DataFrame | None = None, id_col: str = "query_id", query: str = "query", listed: int = LISTED) -> DataFrame:
    """Queries with their topics, terms, populations and variants from lexicon tables.

    ``lexicon``: (place, topic, triggers, zh_terms, en_terms); ``populations``:
    (place, population, triggers); ``compatible``: (topic, topics), whose lists are
    joined where a topic has several. A lexicon of up to ``listed`` entries is
    gathered into one row that every query meets; of a larger one only the entries
    meet a query that share a gram with it.
    """
    q = queries.withColumn("cleaned_query", text.collapse_space(F.col(query)))
    struct = "array<struct<topic:string,population:string,zh_terms:array<string>,en_terms:array<string>>>"

    def met(out: DataFrame, df: DataFrame | None, name: str) -> DataFrame:
        """Every query with the entries of a list that one of their triggers brings up, in the list's order."""
        if df is None:
            return out.withColumn(name, F.array().cast(struct))
        if df.limit(listed + 1).count() > listed:
            return lexicons.entries_met(out, df, name, "cleaned_query")
        whole = df.agg(F.array_sort(F.collect_list(F.struct("place", *(c for c in df.columns if c != "place")))).alias(name))
        hit = F.filter(name, lambda e: F.exists(e["triggers"], lambda t: F.contains(F.lower("cleaned_query"), F.lower(t))))
        return out.crossJoin(broadcast_if_small(settle(whole, name))).withColumn(name, hit)  # one row

    out = met(met(q, lexicon, "lexicon"), populations, "people")
    pick = lambda source, f: text.distinct_ignoring_case(F.transform(source, lambda e: e[f]))
    terms = lambda f: text.distinct_ignoring_case(F.flatten(F.transform("lexicon", lambda e: e[f])))
    out = out.withColumns({"matched_topics": pick("lexicon", "topic"), "zh_terms": terms("zh_terms"), "en_terms": terms("en_terms"), "populations": pick("people", "population")}).drop("lexicon", "people")
    line = lambda *cs: F.array_join(F.concat(*cs), " ")
    variants = F.array(F.col("cleaned_query"), line("zh_terms"), line("en_terms"), line(F.array("cleaned_query"), "zh_terms", "en_terms"))
    out = out.withColumn("query_variants", text.distinct_ignoring_case(variants))
    expanded = F.coalesce(F.try_element_at("query_variants", F.lit(-1)), F.col("cleaned_query"))
    out = out.withColumns({"expanded_query": expanded, "contains_cjk": text.contains_cjk(F.col("cleaned_query"))})
    topics = F.transform("matched_topics", text.metadata_key)
    if compatible is None:
        return out.withColumns({"primary_topics": F.slice(topics, 1, 1), "desired_topics": topics})
    pairs = compatible.groupBy("topic").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("topics"))
    pairs = pairs.agg(F.map_from_entries(F.collect_list(F.struct("topic", "topics"))).alias("_goes_with"))
    out = out.crossJoin(broadcast_if_small(settle(pairs, "compatible-topics")))  # one row
    more = lambda t: F.concat(F.array(t), F.coalesce(F.col("_goes_with")[t], F.array().cast("array<string>")))
    desired = F.array_distinct(F.flatten(F.transform(topics, more)))
    return out.withColumns({"primary_topics": F.array_distinct(F.flatten(F.transform(F.slice(topics, 1, 1), more))), "desired_topics": desired}).drop("_goes_with")


def expand_aliases(tags: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Each tag, its key, the key's words, and what the alias table has for it."""
    key = lambda t: F.regexp_replace(F.lower(text.strip(t)), r"[\s\-]+", "_")
    table = F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), _strings(list(v))))) if aliases else F.create_map().cast("map<string,array<string>>")
    return text.distinct_ignoring_case(F.flatten(F.transform(tags, lambda t: F.concat(F.array(t, key(t), F.replace(key(t), F.lit("_"), F.lit(" "))), F.coalesce(table[key(t)], F.array().cast("array<string>"))))))


def search_text(fields: Sequence[str], topics: Column, populations: Column, topic_aliases: Mapping[str, Sequence[str]], population_aliases: Mapping[str, Sequence[str]]) -> Column:
    """What of a chunk is indexed: its fields and its tags with their aliases."""
    parts = [F.when(~text.is_blank(F.col(f).cast("string")), F.col(f).cast("string")) for f in fields]
    return F.concat_ws(" ", *parts, F.array_join(expand_aliases(topics, topic_aliases), " "), F.array_join(expand_aliases(populations, population_aliases), " "))


#: Values of a context that say nothing. Fixed values.
SILENT = ("", "neutral", "general", "low", "unknown")


def context_terms(context: Mapping[str, Column], terms: Mapping[str, Sequence[str]]) -> Column:
    """The search terms of a context's emotion, cause, strategy and risk_level, in that order; values that say nothing have none."""
    table = F.create_map(*(x for k, v in terms.items() for x in (F.lit(k), _strings(list(v))))) if terms else F.create_map().cast("map<string,array<string>>")
    values = [F.lower(text.strip(context[k])) for k in ("emotion", "cause", "strategy", "risk_level") if k in context]
    of = lambda v: F.when(~v.isin(*SILENT), F.coalesce(table[v], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*map(of, values))) if values else F.array().cast("array<string>")


def in_domain(query: Column, terms: Sequence[str], context: Sequence[Column] = ()) -> Column:
    """Whether a query belongs here: one of the terms in it, or a context that says something."""
    said = (~F.lower(text.strip(c)).isin(*SILENT, "supportive_listening") for c in context)
    return reduce(lambda a, b: a | b, said, text.contains_any(F.lower(query), terms))


def expanded_query(query: Column, expansions: Mapping[str, Sequence[str]], most: int = 6) -> Column:
    """The cleaned query and the first ``most`` expansions of the keys that it contains, in the keys' order."""
    cleaned = text.collapse_space(query)
    of = (F.when(F.contains(cleaned, F.lit(k)), _strings(list(v))).otherwise(F.array().cast("array<string>")) for k, v in expansions.items())
    return F.concat_ws(" ", cleaned, F.array_join(F.slice(F.flatten(F.array(*of)), 1, most), " ")) if expansions and most else cleaned


#: What a case's mode adds to its query, and the collections it may use. Fixed values.
MODE_WORDS = {"safety_only": "safety planning crisis referral", "psychoeducation_only": "psychoeducation professional help"}
ORDINARY = ("interventions", "professional_knowledge", "campus_support")
MODE_COLLECTIONS = {"safety_only": ("safety",), "psychoeducation_only": ("professional_knowledge",)}


def case_request(query: Column, modes: Column, topics: Column, guarded: Column | None = None) -> tuple[Column, Column]:
    """(query, collections) that a case is run with: its mode's words and first five topics, and its mode's collections."""
    chain, allowed = F, F
    for mode, words in MODE_WORDS.items():
        chain = chain.when(F.array_contains(modes, mode), text.strip(F.concat_ws(" ", query, F.lit(words), F.array_join(F.slice(topics, 1, 5), " "))))
        allowed = allowed.when(F.array_contains(modes, mode) & ~(F.lit(False) if guarded is None else guarded), _strings(MODE_COLLECTIONS[mode]))
    return chain.otherwise(query), allowed.otherwise(_strings(ORDINARY))


# --- the whole chain --------------------------------------------------------


def retrieve(queries: DataFrame, chunks: DataFrame, found: DataFrame, top: int = 3, collections: Sequence[str] | None = None, filters: Mapping[str, Sequence[str]] | None = None, staging: bool = True, mode: str = "staging", rrf_k: int = 45, min_relevance: float = 0.26, min_vector: float = 0.46, boundary: Boundary | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, citation_label, scores, content_preview, ...) for rewritten queries.

    ``queries`` come from ``rewrite_queries``; ``found`` has the candidates of
    both indexes (query_id, chunk_id, source, rank, score). Policy predicates are
    applied to the chunk table before it meets the candidates.
    """
    asked = queries
    if boundary is not None:
        asked = asked.where(boundary.reason(F.col("query"), collections or (), filters) == "")
    allowed = chunks.where(user_facing(collections, filters) & review_allowed(F.col("review_status"), staging, mode) & matches_filter(filters or {}) & ~text.is_blank(F.col("content")))
    candidates = settle(merge_candidates(found), "candidates")  # so that few of them meet the texts where these lie
    rows = allowed.join(broadcast_if_small(candidates, 256), "chunk_id").join(broadcast_if_small(settle(asked, "rewritten-queries"), 4096, 5_000), "query_id")
    fields = [F.col("title"), F.col("section"), F.array_join("topic_tags", " "), F.array_join("population_tags", " "), F.col("content")]
    rows = rows.where(term_support(F.concat("en_terms", "zh_terms"), *fields))
    rows = with_boosts(with_rerank(with_rrf(rows, rrf_k), "expanded_query"))
    rows = with_boosts(with_fusion(rows))
    rows = keep_population_matches(dedupe_ranked(rows)).where(score_gate(min_relevance, min_vector))
    best = top_k(rows, "rerank_score", max(top, 1), tie="chunk_id")
    return source_rows(best)


def source_rows(best: DataFrame) -> DataFrame:
    """The rows that are shown: label, preview, what vouches for them."""
    evidence = F.when(text.is_blank(F.col("evidence_level")), "source_unverified").otherwise(F.col("evidence_level"))
    return best.select(
        "query_id", "rank", "chunk_id", "source_id", F.concat(F.lit("来源"), F.col("rank").cast("string")).alias("citation_label"), "title", "section", "content",
        F.substring("content", 1, 240).alias("content_preview"), "rerank_score", "semantic_score", "keyword_score", "vector_score", "fusion_score", "retrieval_sources",
        ((evidence != "source_unverified") & ~text.is_blank(F.col("organization"))).alias("is_verified"), F.lower("review_status").isin("approved", "reviewed").alias("reviewed"), "target_collection", "language",
    )
