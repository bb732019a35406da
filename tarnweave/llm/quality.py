"""Quality classification by importance resampling.

Texts become hashed n-grams (words, word pairs, and pairs of word shapes such as
upper case, punctuation or a word said again). Two generative models count them:
one over target texts, one over the raw corpus. A text's log weight is the sum of
the log ratio of the two over its n-grams, and a sample without replacement in
proportion to the weights is drawn by Gumbel top-k: the k largest sums of log
weight and Gumbel noise.

The target model is fitted on at most ``target_rows`` labelled rows of quality 1
(those of the smallest hash of the id); raw counts, scores and the sample cover
all rows. k is the number of rows whose log weight lies above the cut that parts
the labelled rows best, so k grows with the corpus.

Defined cases: null and empty texts have no n-grams and log weight 0; labels with
a null id or quality are ignored, an id with several labels counts as target if
all of them are 1; without labels of both kinds the cut is 0. Rows of one id and
text have one score and one noise and stay or go together; an empty table gives
an empty result; other columns are ignored by ``sample`` and kept by ``keep_selected``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm._arrow import blocks, flat_text, mix64, release
from tarnweave.session import settle

#: Hash buckets of n-grams.
BUCKETS = 1 << 16
#: Labelled target rows that the target model is fitted on at most.
TARGET_ROWS = 50_000
#: How much worse than the best a lower cut may part the labelled rows.
SLACK = 0.02
#: Added to each count of a bucket.
SMOOTH = 1.0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes, and rows, that one step works on.
BLOCK, SLICE = 1 << 18, 1_024

SPACE, WORD, MARK = 0, 1, 2
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[:33] = SPACE
_CLASS[127] = SPACE
_CLASS[128:] = WORD
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _CLASS[_a:_b] = WORD
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, for one block."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(BLOCK + 1, BASE, np.uint64), np.full(BLOCK + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and length. Prefix sums are made block by block, so a long word needs no more memory than a short one."""
    up, down = _powers()
    places = np.column_stack([start, end]).ravel()
    sums, carry, scale = np.zeros(len(places), np.uint64), np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(flat) + 1, BLOCK):
        part = flat[at : at + BLOCK]
        local = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=local[1:])
        lo, hi = np.searchsorted(places, [at, at + BLOCK])
        sums[lo:hi] = carry + scale * local[places[lo:hi] - at]
        carry, scale = carry + scale * local[-1:], scale * up[BLOCK:]
    far = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(flat) // BLOCK, down[BLOCK], np.uint64)]))
    shift = down[start % BLOCK] * far[start // BLOCK]
    return mix64((sums[1::2] - sums[::2]) * shift + (end - start).astype(np.uint64))


def _words(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words and marks of a block of texts."""
    kind = _CLASS[flat]
    cut = np.zeros(len(flat), bool)
    cut[bounds[:-1][bounds[:-1] < len(flat)]] = True
    edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | cut[1:]])
    real = kind[edge] != SPACE
    return edge[real], np.r_[edge[1:], len(flat)][real]


def ngrams(flat: np.ndarray, bounds: np.ndarray, seen: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all n-grams of a block of texts; the first ``seen`` words were counted with the piece before."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = _words(flat, bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _word_hashes(flat, start, end)
    row = np.searchsorted(bounds, start, "right") - 1
    caps, nums = (np.cumsum(of[flat], dtype=np.int32) for of in (_UPPER, _DIGIT))
    n_caps, n_nums = (n[end - 1] - n[start] + of[flat[start]] for n, of in ((caps, _UPPER), (nums, _DIGIT)))
    size = end - start
    shape = np.where(_CLASS[flat[start]] == MARK, 5, np.where(n_nums == size, 4, np.where((n_caps == size) & (size > 1), 3, np.where(n_caps > 0, 2, 1)))).astype(np.uint64)
    same = row[1:] == row[:-1]
    again = np.r_[False, same & (word[1:] == word[:-1])]
    shape = shape + np.uint64(8) * again.astype(np.uint64)
    if seen:
        same[: seen - 1] = False  # the pairs within what was seen
    pair = (word[:-1] * np.uint64(31) + word[1:])[same]
    shapes = (shape[:-1] * np.uint64(64) + shape[1:] + np.uint64(1 << 20))[same]
    keys = np.concatenate([word[seen:], mix64(pair), mix64(shapes)])
    rows = np.concatenate([row[seen:], row[1:][same], row[1:][same]])
    return (keys >> np.uint64(48)).astype(np.int64) % BUCKETS, rows


def _pieces(flat: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, bounds, first row, words seen) of bounded pieces.

    A long text is cut between words, and a piece begins with the last two words
    of the one before, on which its first pairs depend: cuts change no count.
    """
    for a, b in blocks(bounds, BLOCK):
        at, stop = int(bounds[a]), int(bounds[b])
        if stop - at <= 2 * BLOCK:
            yield flat[at:stop], bounds[a : b + 1] - at, a, 0
            continue
        seen, to = 0, at
        while to < stop:
            to = min(to + BLOCK, stop)
            while to < stop and _CLASS[flat[to]] == _CLASS[flat[to - 1]]:
                ahead = _CLASS[flat[to : to + BLOCK]] != _CLASS[flat[to - 1]]
                to += int(np.argmax(ahead)) if ahead.any() else len(ahead)
            ends = np.array([0, to - at])
            yield flat[at:to], ends, a, seen
            start, _ = _words(flat[at:to], ends)
            seen = min(2, len(start))
            at += int(start[-seen]) if seen else to - at


def _counts(df: DataFrame) -> DataFrame:
    """(bucket, n) over all texts of a one-column frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                for flat, bounds, _, seen in _pieces(*flat_text(batch.column(0).slice(at, SLICE))):
                    total += np.bincount(ngrams(flat, bounds, seen)[0], minlength=BUCKETS)
        release()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _model(df: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets; what comes to the driver is one number a bucket."""
    n = np.full(BUCKETS, SMOOTH)
    for bucket, count in _counts(df).collect():
        n[bucket] += count
    return np.log(n / n.sum())


def labelled(labels: DataFrame, id_col: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(id, quality): one row per labelled id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(quality).cast("int")).alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", target_rows: int = TARGET_ROWS) -> np.ndarray:
    """The log ratio of each bucket: target model over raw model."""
    target = labelled(labels, id_col).where("quality = 1").orderBy(F.xxhash64("id"), "id").limit(target_rows).select("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    return _model(texts.join(F.broadcast(target), "id", "left_semi").select("t")) - _model(texts.select("t"))


def _row_scores(column: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, number of n-grams) of each text of a column."""
    total, count = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for at in range(0, len(column), SLICE):
        for flat, bounds, first, seen in _pieces(*flat_text(column.slice(at, SLICE))):
            bucket, row = ngrams(flat, bounds, seen)
            n, to = len(bounds) - 1, at + first
            total[to : to + n] += np.bincount(row, weight[bucket], n)
            count[to : to + n] += np.bincount(row, minlength=n)
    return total, count


def scores(docs: DataFrame, ratio: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, log_weight, n_grams) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _row_scores(batch.column(1), shared.value))], names=["id", "log_weight", "n_grams"])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string")).mapInArrow(run, f"id {kind}, log_weight double, n_grams long")


def best_cut(known: DataFrame, bins: int = 4096, slack: float = SLACK) -> float:
    """The log weight that parts the labelled rows: of all cuts within ``slack`` of the best, the lowest.

    A cut is the better, the larger the share of quality 0 below it less that of
    quality 1; the lowest of the good ones spares rows of quality 1 that none of
    the labelled resemble. ``known`` has (log_weight, quality). Only counts of
    bins come to the driver.
    """
    bin_of = F.floor(F.signum("log_weight") * F.log1p(F.abs("log_weight")) * 256).cast("int")
    counts = known.groupBy(F.greatest(F.lit(-bins), F.least(F.lit(bins), bin_of)).alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    n_good, n_bad = sum(r["good"] for r in counts), sum(r["bad"] for r in counts)
    if not n_good or not n_bad:
        return 0.0
    good, bad, found = 0, 0, []
    for r in sorted(counts):
        good, bad = good + r["good"], bad + r["bad"]
        x = (r["bin"] + 1) / 256
        found.append((bad / n_bad - good / n_good, float(np.sign(x) * np.expm1(abs(x)))))
    best = max(f for f, _ in found)
    return min(cut for f, cut in found if f >= best - slack) if best > 0 else 0.0


def kth_largest(keys: DataFrame, k: int, column: str = "sample_key") -> float:
    """The k-th largest value of a settled column, by counting in ever narrower bins.

    The driver gets at most 1,024 counts or 4,096 values a round; no round sorts
    or moves the rows.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    while high > low:
        inside = keys.where(F.col(column).between(low, high))
        place = F.least(F.lit(1023), F.floor((F.col(column) - low) / ((high - low) / 1024))).cast("int")
        bins = {r["bin"]: r for r in inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for at in sorted(bins, reverse=True):
            if above + bins[at]["n"] >= k:
                break
            above += bins[at]["n"]
        low, high = bins[at]["low"], bins[at]["high"]
        if bins[at]["n"] <= 4096:
            rest = sorted((r[0] for r in keys.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return rest[min(k - above, len(rest)) - 1]
    return low


def sample_key(row_id: Column, log_weight: Column, seed: int = 42) -> Column:
    """Log weight plus the Gumbel noise of the row's id."""
    part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_id, F.round(log_weight, 6)), 11)
    u = (part.cast("double") + 0.5) / float(1 << 53)
    return log_weight - F.log(-F.log(u))


def _drawn(docs: DataFrame, labels: DataFrame, text: str, id_col: str, seed: int) -> tuple[DataFrame, np.ndarray, float]:
    """The scored rows, the model's log ratio, and the least key that is in the sample."""
    ratio = fit(docs, labels, text, id_col)
    scored = scores(docs, ratio, text, id_col)
    scored = settle(scored.withColumn("sample_key", sample_key(F.col("id"), F.col("log_weight"), seed)), "quality-scores")
    cut = best_cut(scored.join(labelled(labels, id_col), "id").select("log_weight", "quality"))
    k = scored.where(F.col("log_weight") >= cut).count()
    return scored, ratio, kth_largest(scored, k)


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """(id, log_weight, n_grams, sample_key, selected) of every row of ``docs``."""
    scored, _, least = _drawn(docs, labels, text, id_col, seed)
    return scored.select(F.col("id").alias(id_col), "log_weight", "n_grams", "sample_key", (F.col("sample_key") >= least).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that the sample selects, with their columns.

    A key follows from a row alone, so rows are scored once more instead of
    being brought together with their keys: no text is shuffled.
    """
    _, ratio, least = _drawn(docs, labels, text, id_col, seed)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weigh(column: pa.Array) -> pa.Array:
        return pa.array(_row_scores(column, shared.value)[0])

    return docs.where(sample_key(F.col(id_col), weigh(F.col(text).cast("string")), seed) >= least)
