"""Removal of long repeated strings by bucket-pointer refinement.

Every byte that a string of ``length`` (200) bytes covers which also starts
anywhere else, in the same or another text, is removed. A suffix array over all
bytes isn't needed for that: what counts is which suffixes agree in their first
200 bytes. Buckets of suffixes are refined until that is known:

1. Initial buckets are q-grams (``GRAM`` bytes); a bucket's identifier is the hash of
   its q-gram. Of each string of 200 bytes one q-gram stands for it, the one of least
   identifier (the last of equals), so only about one byte position in 75 gets a row.
   The strings that one position stands for are neighbours and form a run. Runs
   whose q-gram bucket has one member are settled: none of their strings repeats.
2. Buckets are refined by the identifiers of the buckets at later offsets. An
   identifier of level j + 1 is made of the identifier of level j of a position and
   that of the position 2^j q-grams on, so each level reuses the one before and a few
   levels reach over any span (``Identifiers``). A run's bucket is refined by the
   identifier of all bytes that its strings cover. Runs in a refined bucket of two or
   more are settled: all their strings repeat.
3. Only runs at the ends of repeats are left. They are cut into pieces of up to
   ``PIECE`` strings at fixed distances from the q-gram, so that pieces of equal
   strings are cut alike. A piece's bucket is refined by the identifier of the bytes
   that all its strings share: a piece alone in there has no string that repeats.
   Pieces with all bytes equal are settled, and of each such group one goes on as a model.
4. What is left, about one piece a run, is refined once more, one row per string, by
   two independent identifiers of its 200 bytes. A group of two or more repeats.

Identifiers are hashes of 64 bits and not ranks, so no level needs a sort of all
positions: levels are made where the text lies, and Spark groups by them. A decision
takes equality of two identifiers of different hashes, 128 bits.

Hot buckets are counted with partial counts; the counts are settled before they are
joined back, so that Spark may split the rows of a hot bucket. Nothing is collected
but a text's own runs.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; repeated
rows are copies of each other; an empty table gives an empty result; other columns
are ignored. Positions are UTF-8 bytes, and what is left need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.llm._arrow import BLOCK_BYTES, mix64
from tarnweave.session import broadcast_if_small, drop_settled, settle

LENGTH = 200
GRAM = 50
#: Strings of a piece of a run in the third step.
PIECE = 10
#: Two odd bases of polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64
#: Positions up to which all identifiers of a level are made, and not only those asked for.
FEW_PLACES = 8_192


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=4)
def _letters(base: int) -> np.ndarray:
    """A random-looking number for each byte."""
    return mix64(np.arange(1, 257, dtype=_U) * _U(base))


class Identifiers:
    """Bucket identifiers of one block of bytes: of q-grams, and of longer spans by levels.

    Level 0 holds the identifier of the q-gram at each position, from prefix sums
    of its letters. Level j has that of the 2^j q-grams one after the other from a
    position on, made of two of level j - 1. A span is named by the level that fits
    into it: at its start, and at its end, where the two may overlap.
    """

    def __init__(self, data: np.ndarray, base: int, gram: int) -> None:
        self.up, self.down = _powers(base, 1 << max(16, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_letters(base)[data] * self.up[: len(data)], out=self.sums[1:])
        self.n, self.gram, self.base = len(data) - gram + 1, gram, base
        self.levels: list[np.ndarray] = []

    def _factor(self, j: int) -> np.uint64:
        """What the first half of a level is multiplied by; it differs by level, so no two of its q-grams can change places."""
        return _U(pow(self.base, 1 << (j - 1), 1 << 64))

    def level(self, j: int) -> np.ndarray:
        """The identifiers of one level at all positions."""
        while len(self.levels) <= j:
            if not self.levels:
                self.levels.append(mix64((self.sums[self.gram :] - self.sums[: self.n]) * self.down[: self.n]))
                continue
            ids, step = self.levels[-1], self.gram << (len(self.levels) - 1)
            self.levels.append(ids[: max(0, len(ids) - step)] * self._factor(len(self.levels)) + ids[step:])
        return self.levels[j]

    def at(self, j: int, places: np.ndarray) -> np.ndarray:
        """The identifiers of one level at some positions."""
        if j == 0:
            return mix64((self.sums[places + self.gram] - self.sums[places]) * self.down[places])
        return self.at(j - 1, places) * self._factor(j) + self.at(j - 1, places + (self.gram << (j - 1)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The identifiers of spans of a q-gram or more."""
        size = stop - start
        level = np.frexp(size // self.gram)[1] - 1  # the highest power of two
        dense = self.n <= FEW_PLACES or 4 * len(start) > self.n
        out = np.empty(len(start), _U)
        low, high = int(level.min(initial=99)), int(level.max(initial=-1))
        for j in range(low, high + 1):
            own = slice(None) if low == high else np.flatnonzero(level == j)
            first, back = start[own], stop[own] - (self.gram << j)
            one, two = (self.level(j)[first], self.level(j)[back]) if dense else (self.at(j, first), self.at(j, back))
            out[own] = one * _U(BASES[1]) + two
        return mix64(out * _U(BASES[0]) + size.astype(_U))


def least_places(values: np.ndarray, window: int) -> np.ndarray:
    """For each window of values the place of its least one, of equals the last."""
    n = len(values) - window + 1
    places = np.arange(len(values))
    best, width = places[: len(values)], 1
    # windows of doubled width from two overlapping halves
    while width * 2 <= window:
        a, b = best[: len(best) - width], best[width:]
        best = np.where(values[b] <= values[a], b, a)
        width *= 2
    if width < window:
        a, b = best[:n], best[window - width : window - width + n]
        best = np.where(values[b] <= values[a], b, a)
    return best[:n]


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first, last, place, bucket, span) of the runs of one text of at least ``length`` bytes.

    ``place`` is where the q-gram starts, ``bucket`` its identifier, ``span`` that of all bytes of the run's strings, of another base.
    """
    grams = Identifiers(data, BASES[0], gram).level(0)
    stands = least_places(grams, length - gram + 1)
    cut = np.flatnonzero(stands[1:] != stands[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(stands) - 1]])
    return first, last, stands[first], grams[stands[first]], Identifiers(data, BASES[1], gram).of(first, last + length)


def _parts(data: bytes, length: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts of a text: each string of ``length`` bytes lies in exactly one of them."""
    flat, at = np.frombuffer(data, np.uint8), 0
    while len(flat) - at >= length:
        yield at, flat[at : at + block + length - 1]
        at += block


KEY = "k long, h long"


def _run_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, h, first, last, place, bucket, span) of all runs of all texts."""
    schema = f"{KEY}, first int, last int, place int, bucket long, span long"

    def out(keys: list[tuple[int, int]], cols: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        spread = np.repeat(np.array(keys, np.int64), [len(c[0]) for c in cols], axis=0)
        first, last, place, bucket, span = (np.concatenate(c) for c in zip(*cols, strict=True))
        arrays = [spread[:, 0], spread[:, 1], *(x.astype(np.int32) for x in (first, last, place)), bucket.view(np.int64), span.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], names=["k", "h", "first", "last", "place", "bucket", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cols, held = [], [], 0
            for k, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for at, part in _parts(text.as_py(), length):
                    first, last, place, *rest = runs_of(part, length, gram)
                    keys.append((k, h))
                    cols.append((first + at, last + at, place + at, *rest))
                    held += len(first)
                if held > 20_000:
                    yield out(keys, cols)
                    keys, cols, held = [], [], 0
            if keys:
                yield out(keys, cols)

    return texts.select("k", "h", "data").mapInArrow(run, schema)


def _open_rows(texts: DataFrame, length: int, schema: str, of_runs: Callable[[np.ndarray, dict[str, np.ndarray], int], dict[str, np.ndarray]]) -> DataFrame:
    """Rows that ``of_runs`` makes of the runs in ``open``, a list of (first, last, place, model).

    Runs that lie close together are hashed together, and only the bytes they need:
    ``of_runs`` gets these bytes, the runs' columns and where the bytes start.
    """
    names = [c.split(" ")[0] for c in f"{KEY}, {schema}".split(", ")]

    def of_text(k: int, h: int, data: np.ndarray, runs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, last = runs["first"], runs["last"]
        far = np.flatnonzero((first[1:] - np.maximum.accumulate(last)[:-1] > length) | (np.diff(first // BLOCK_BYTES) > 0)) + 1
        for lo, hi in zip([0, *far.tolist()], [*far.tolist(), len(first)], strict=True):
            own = {c: v[lo:hi] for c, v in runs.items()}
            base = int(own["first"][0])
            made = of_runs(data[base : int(own["last"].max()) + length], own, base)
            n = len(next(iter(made.values())))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int64)), pa.array(np.full(n, h, np.int64)), *(pa.array(v) for v in made.values())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for k, h, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                cols = [s.to_numpy(zero_copy_only=False) for s in spans.values.flatten()]
                order = np.lexsort((cols[1], cols[0]))
                runs = {c: v[order].astype(bool if c == "model" else np.int64) for c, v in zip(("first", "last", "place", "model"), cols, strict=True)}
                for rows in of_text(k, h, np.frombuffer(text.as_py(), np.uint8), runs):
                    made.append(rows)
                    held += len(rows)
                if held > 50_000:
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                    made, held = [], 0
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return texts.select("k", "h", "data", "open").mapInArrow(run, f"{KEY}, {schema}")


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values from ``low`` to ``high`` of each row."""
    n = high - low + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _piece_rows(texts: DataFrame, length: int, gram: int, size: int = PIECE) -> DataFrame:
    """(k, h, first, last, place, model, no, core, span, part): runs in pieces. ``core`` is the identifier of the bytes that all
    strings of a whole piece share, ``span`` of all their bytes; where the run has only a part of a piece, span tells it from others."""

    def of_runs(data: np.ndarray, runs: dict[str, np.ndarray], base: int) -> dict[str, np.ndarray]:
        one, two = (Identifiers(data, b, gram) for b in BASES)
        place = runs["place"]
        row, no = _spread((place - runs["last"]) // size, (place - runs["first"]) // size)
        place = place[row]
        near, far = no * size, np.minimum(no * size + size - 1, length - gram)  # distances of the q-gram from a string's start
        first, last = np.maximum(place - far, runs["first"][row]), np.minimum(place - near, runs["last"][row])
        core = one.of(place - near - base, place - far + length - base)
        part = (first > place - far) | (last < place - near)
        span = two.of(first - base, last + length - base)
        return {
            "first": first.astype(np.int32), "last": last.astype(np.int32), "place": place.astype(np.int32), "model": runs["model"][row],
            "no": no.astype(np.int16), "core": core.view(np.int64), "span": span.view(np.int64), "part": part,
        }

    rows = _open_rows(texts, length, "first int, last int, place int, model boolean, no short, core long, span long, part boolean", of_runs)
    return rows.withColumn("span", F.when(F.col("part"), F.xxhash64("k", "h", "first")).otherwise(F.col("span")))


def _string_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, h, at, model, a, b) of every string of the open runs."""

    def of_runs(data: np.ndarray, runs: dict[str, np.ndarray], base: int) -> dict[str, np.ndarray]:
        row, at = _spread(runs["first"], runs["last"])
        a, b = (Identifiers(data, x, gram).of(at - base, at - base + length).view(np.int64) for x in BASES)
        return {"at": at.astype(np.int32), "model": runs["model"][row], "a": a, "b": b}

    return _open_rows(texts, length, "at int, model boolean, a long, b long", of_runs)


def covered(first: np.ndarray, last: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, stop) of bytes under strings that start at first to last."""
    order = np.argsort(first, kind="stable")
    start, stop = first[order], last[order] + length
    reach = np.maximum.accumulate(stop)
    fresh = np.concatenate([[True], start[1:] > reach[:-1]])
    begin = np.flatnonzero(fresh)
    return start[begin], np.minimum(reach[np.concatenate([begin[1:] - 1, [len(start) - 1]])], size)


def _cut_texts(texts: DataFrame, id_field: T.StructField, length: int, keep: bool) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) from the repeated strings in ``gone``."""
    fields = [id_field, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    schema = T.StructType(fields if keep else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts_left = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                start = stop = np.zeros(0, np.int64)
                if spans.is_valid and len(spans):
                    first, last = (s.to_numpy().astype(np.int64) for s in spans.values.flatten())
                    start, stop = covered(first, last, length, len(data))
                pieces = [data[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(data)], strict=True)]
                left = b"".join(pieces)
                counts.append((len(data), int((stop - start).sum()), len(start)))
                digests.append(hashlib.sha256(left).hexdigest())
                texts_left.append(left if keep else None)
            n = np.array(counts, np.int64).reshape(-1, 3)
            arrays = [batch.column(0), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(3)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts_left, pa.binary())] * keep, names=schema.names)

    return texts.select(id_field.name, "data", "gone").mapInArrow(run, schema)


def _with_open(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """The texts that have open runs (k, h, first, last, place, model), with a list of these."""
    lists = settle(runs.groupBy("k", "h").agg(F.collect_list(F.struct("first", "last", "place", "model")).alias("open")), "open-runs")
    some = texts.join(broadcast_if_small(lists.select("k", "h"), 32, 500_000), ["k", "h"], "left_semi")
    return some.join(lists, ["k", "h"])


def _refined(rows: DataFrame, *key: str) -> DataFrame:
    """Refined buckets: (key, n, one of the bucket's rows)."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "first", "last", "place", "model")).alias("one"))


def _of_those(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows with one of the keys, which are settled first: the join then reads both sides as they are and may split a hot key.

    Keys grow with the corpus, so they are never broadcast, and all sizes are joined alike.
    """
    keys = settle(keys, name)
    return rows.join(keys.hint("merge"), keys.columns, "left_semi")


def repeated_strings(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k, h, first, last): where strings start that also start elsewhere. ``texts`` has (k, h, data)."""
    texts = texts.where(F.octet_length("data") >= length)
    runs = settle(_run_rows(texts, length, gram), "runs")
    shared = runs.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    live = settle(_of_those(runs, shared, "shared-buckets").withColumn("model", F.lit(False)), "live-runs")
    drop_settled(runs)
    refined = settle(_refined(live, "bucket", "span"), "refined-buckets")
    whole = _of_those(live, refined.where("n > 1").select("bucket", "span"), "whole-buckets").select("k", "h", "first", "last")
    # a string of an open run may also start in a settled run of its bucket; one run of each refined bucket speaks for that
    opened = refined.where("n = 1").select("bucket").distinct()
    ends = _of_those(refined, opened, "open-buckets").select("one.k", "one.h", "one.first", "one.last", "one.place", (F.col("n") > 1).alias("model"))

    pieces = settle(_piece_rows(_with_open(texts, ends), length, gram), "pieces")
    groups = settle(_refined(pieces, "no", "core", "span", "part"), "refined-pieces")
    settled = _of_those(pieces.where("not model"), groups.where("n > 1").select("no", "core", "span", "part"), "whole-pieces").select("k", "h", "first", "last")
    several = groups.groupBy("no", "core").agg(F.count("*").alias("groups")).where("groups > 1").select("no", "core")
    rest = _of_those(groups, several, "open-pieces").select("one.k", "one.h", "one.first", "one.last", "one.place", (F.col("one.model") | (F.col("n") > 1)).alias("model"))

    strings = settle(_string_rows(_with_open(texts, rest), length, gram), "strings")
    twice = strings.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    alone = _of_those(strings.where("not model"), twice, "repeated-strings").select("k", "h", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.union(settled).union(alone)


#: Keys of texts that are sent to all tasks at most; beyond that all texts are joined by a shuffle.
FEW_KEYS = 500_000


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, keep: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    data = F.coalesce(F.encode(F.col(text), "UTF-8") if dict(documents.dtypes)[text] == "string" else F.col(text), F.lit(b""))
    # two hashes tell rows apart; rows that agree in both repeat id and text, and repeat each other's strings
    rows = documents.select(F.col(id_col).alias("row_id"), data.alias("data")).withColumns({"k": F.xxhash64("data"), "h": F.xxhash64(F.lit("id"), "row_id")})
    # settled, so that copies of one id and text needn't meet in the task that has gathered their runs
    gone = settle(repeated_strings(rows, length).groupBy("k", "h").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "removals")
    keys = gone.select("k", "h")
    if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        # only texts that lose something are moved
        keys = broadcast_if_small(keys, 32, FEW_KEYS)
        cut = rows.join(keys, ["k", "h"], "left_semi").join(gone, ["k", "h"])
        marked = cut.unionByName(rows.join(keys, ["k", "h"], "left_anti").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType)))
    else:
        marked = rows.join(gone, ["k", "h"], "left")
    id_field = T.StructField("row_id", documents.schema[id_col].dataType)
    return _cut_texts(marked, id_field, length, keep).withColumnRenamed("row_id", id_col)
