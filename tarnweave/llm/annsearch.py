"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook of ``CELLS``
centroids, so a pair of centroids names one of CELLS x CELLS cells. Every vector is
indexed in its cell. For a query, pairs of centroids are visited from the nearest
on, by the sum of the two halves' distances, with a heap (the multi-sequence
walk), until the cells visited hold enough entries; these are reranked exactly,
by the inner product in double precision.

Codebooks are fitted on at most ``SAMPLE`` vectors (those of the smallest hash of
the id); all vectors are indexed and all are candidates. A distance of halves is
the negative inner product with the centroid, whose sum is the nearness sought.
Enough entries are a share of the table, which is measured on the sample: some of its
vectors are searched among all of them by brute force, and the share is what the walk
must see of the sample to meet ``RECALL`` of what they found. Vectors in clusters need
little; those without structure need about four tenths, whatever the index. Queries of
a stated set meet the entries in blocks of bounded size, and one cell may fill many
blocks. Recall is measured in the tests against brute force.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows whose id is null (they neither ask nor are found), nor
vectors of another dimension than the most common one (ties: the larger); equal scores rank by smaller id; a row with the query's id is the
query's own; repeated rows are candidates of their own, and of several query
rows of one id the least vector asks; with fewer candidates than k all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.session import settle

#: Centroids of a half; the cells of one first centroid fit the bits of a long.
CELLS = 64
#: Vectors that codebooks are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
#: Share of the sample's nearest that must be seen, queries it is measured with, and the least number of entries seen, so that small tables come whole.
RECALL, ASKED, LEAST = 0.95, 256, 400
#: Entries of one block, and queries that meet it at once.
BLOCK, BATCH = 8_192, 256


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def prepared(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, of one dimension."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = settle(rows.where(F.col("id").isNotNull() & usable(F.col("v"))), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["d"]) if sizes else rows


def _codebook(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows of ``x`` by Lloyd's rounds from evenly picked distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], len(centres))
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The vectors that codebooks and share are fitted on: those of the smallest hash of the id."""
    return np.array([r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], np.float64)


def fit(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks of the two halves."""
    half = x.shape[1] // 2
    return _codebook(x[:, :half], cells), _codebook(x[:, half:], cells)


def needed_share(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float = RECALL, asked: int = ASKED) -> float:
    """The share of the rows of ``x`` that a walk must see so that it meets ``recall`` of the k nearest of some of them."""
    half, q = books[0].shape[1], x[:: max(1, len(x) // asked)][:asked]
    own = np.arange(len(x))[:: max(1, len(x) // asked)][:asked]
    exact = q @ x.T
    near = (q[:, :half] @ books[0].T)[:, _nearest(x[:, :half], books[0])] + (q[:, half:] @ books[1].T)[:, _nearest(x[:, half:], books[1])]
    exact[np.arange(len(q)), own] = near[np.arange(len(q)), own] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    # entries that the walk meets no later than the best ones: their cells come at once
    seen = [np.searchsorted(-np.sort(-row)[::-1], row[b], "left") for row, b in zip(near, best, strict=True)]
    return float(np.quantile((len(x) - np.concatenate(seen)) / len(x), recall))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def index(vectors: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, v, c1, c2): each vector's nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = books[0].shape[1]
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                c = [_nearest(h, b).astype(np.int32) for h, b in zip((x[:, :half], x[:, half:]), books, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, c)], names=["id", "v", "c1", "c2"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, c1 int, c2 int")


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids in the order of summed distance until their cells hold ``enough`` entries."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    first, second, sizes = first.tolist(), second.tolist(), sizes.tolist()
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := sizes[a[i]][b[j]]:
            out.append((a[i], b[j]))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def probes(queries: DataFrame, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: int) -> DataFrame:
    """(id, v, c1, mask): for each first centroid that a query visits, the second ones as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = books[0].shape[1]
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                x = _matrix(batch.column(1))
                near = -x[:, :half] @ books[0].T, -x[:, half:] @ books[1].T
                rows, c1, mask = [], [], []
                for k in range(len(x)):
                    bits: dict[int, int] = {}
                    for i, j in walk(near[0][k], near[1][k], sizes, enough):
                        bits[i] = bits.get(i, 0) | 1 << j
                    rows += [k] * len(bits)
                    c1 += bits.keys()
                    mask += (m - (1 << 64) if m >> 63 else m for m in bits.values())
                took = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(c1, pa.int32()), pa.array(mask, pa.int64())], names=["id", "v", "c1", "mask"])

    return queries.select("id", "v").mapInArrow(run, "id long, v array<double>, c1 int, mask long")


def _best(q_ids: np.ndarray, q: np.ndarray, mask: np.ndarray, ids: np.ndarray, c2: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query, id, score) of the k best entries of a block for each query."""
    rough = q @ x.T
    rough[((mask[:, None] >> c2[None, :]) & 1 == 0) | (q_ids[:, None] == ids[None, :])] = -np.inf
    out_q, out_id, out_s = [], [], []
    kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    for r in range(len(q)):
        slack = 1e-9 * (1 + abs(kth[r])) if np.isfinite(kth[r]) else 0
        near = np.flatnonzero((rough[r] >= kth[r] - slack) & np.isfinite(rough[r]))
        score = (x[near] * q[r]).sum(axis=1)  # the same steps for equal vectors, so ties are ties
        best = np.lexsort((ids[near], -score))[:k]
        out_q += [q_ids[r]] * len(best)
        out_id += ids[near][best].tolist()
        out_s += score[best].tolist()
    return out_q, out_id, out_s


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", cells: int = CELLS, share: float | None = None, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (columns as ``df``) the k nearest rows found; without ``share`` it is measured."""
    schema = "query_id long, vec_id long, score double"
    spark = df.sparkSession
    vectors = prepared(df, id_col, vector)
    first = vectors.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = sampled(vectors)
    books = fit(x, cells)
    entries = settle(index(vectors, books), "multi-index")
    counted = entries.groupBy("c1", "c2").count().collect()  # one row per cell, CELLS x CELLS at most
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    for c1, c2, n in counted:
        sizes[c1, c2] = n
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == len(first[0]["v"]))).groupBy("id").agg(F.min("v").alias("v"))
    if share is None:
        share = needed_share(x, books, max(1, round(k * len(x) / sizes.sum())))
    # walks are Python loops: a stated number of tasks, which isn't coalesced
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    asked = settle(probes(asked, books, sizes, max(least, int(np.ceil(share * sizes.sum())))), "probes")

    # entries of a first centroid lie in blocks; each block meets all queries that visit the centroid
    n_blocks = F.element_at(F.array(*(F.lit(int(-(-n // BLOCK) or 1)) for n in sizes.sum(axis=1))), F.col("c1") + 1)
    held = entries.select("c1", F.pmod(F.xxhash64("id", "v"), n_blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v", F.col("c2").cast("long").alias("what"))
    asking = asked.select("c1", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v", F.col("mask").alias("what"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, block = None, [], None
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                c1, part, kind, ids, what = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
                x = _matrix(batch.column(4))
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(c1) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)]))
                for lo, hi in zip(cut, [*cut[1:], len(batch)], strict=True):
                    if key != (c1[lo], part[lo]):
                        key, own, block = (c1[lo], part[lo]), [], None
                    if kind[lo] == 0:
                        own.append((ids[lo:hi], what[lo:hi], x[lo:hi]))
                        continue
                    if own:
                        block, own = tuple(np.concatenate(c) for c in zip(*own, strict=True)), []
                    if block:
                        q, found, score = _best(ids[lo:hi], x[lo:hi], what[lo:hi], *block, k)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    met = held.union(asking).repartition("c1", "block").sortWithinPartitions("c1", "block", "kind").mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
