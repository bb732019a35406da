"""Language identification: a blended-spectrum string kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are alike by the number of n-grams of one to three letters that occur
in both, how often doesn't matter, over the root of both texts' numbers. A model
is learned from a bounded sample: for every language at most ``SAMPLE`` different
texts, those of smallest hash in each of ``SHARES`` classes of hashes. From the sample come the alphabet, the n-grams
that are counted (``GRAMS``), the landmarks (``LANDMARKS`` texts, as many of each
language) and, added up over the sample in Spark tasks, the normal equations of
ridge regression on the texts' kernel values with the landmarks. What comes to
the driver is bounded by these four numbers and by the number of languages, not
by the documents.

As the kernel is a product of presence vectors, the landmarks' coefficients fold
into one weight for each n-gram and language, so a block of texts is scored by one
product: presence matrix times weights. Every text counts whole: long ones are
read in pieces that overlap by two letters.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is all if there
is nothing to learn from. A null language isn't learned from and is predicted. A
null id counts as the empty text. A text of none of the counted n-grams gets the
first language at score 0.5. Repeated texts count once in the sample, and each
row is predicted. Of a table with other columns these stay as they are; names
that would clash get underscores before them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tarnweave.llm._arrow import blocks, flat_text, release
from tarnweave.llm._names import fresh
from tarnweave.session import broadcast_if_small, settle

#: Different texts of a language that a model is learned from.
SAMPLE = 1_000
#: Classes of hashes that a language's sample is taken from, in equal shares.
SHARES = 16
#: Letters told apart; all rarer ones are one more symbol.
ALPHABET = 120
#: N-grams that are counted, those of most sampled texts.
GRAMS = 8_192
#: Sampled texts that others are compared with, over all languages, one of each at least.
LANDMARKS = 256
#: The weight of the ridge, against a mean of squared errors.
RIDGE = 1e-4
#: Code points that one numpy step works on.
PIECE = 1 << 20
#: Rows of a presence matrix at most.
BLOCK_ROWS = 1_024
#: Tasks that the sample is dealt to; each returns one set of partial sums.
TASKS = 8
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from: the checksum of its id, as text, leaves 2 when divided by 4."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


@functools.cache
def _is_letter() -> np.ndarray:
    """A table by code point."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0
    return np.char.isalpha(points.view("<U1"))


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts, bounds); null counts as empty."""
    flat, ends = flat_text(pc.utf8_lower(column.cast(pa.large_string())))
    starts = (flat & 0xC0) != 0x80
    places = np.concatenate([[0], np.cumsum(starts)])
    points = np.empty(int(places[-1]), np.uint32)
    at = 0
    while at < len(flat):
        stop = min(at + PIECE, len(flat))
        while stop < len(flat) and not starts[stop]:
            stop += 1
        points[places[at] : places[stop]] = np.frombuffer(flat[at:stop].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        at = stop
    return points, places[ends]


@dataclass(frozen=True)
class Spectrum:
    """The n-grams that are counted. ``letters``: code points; ``grams``: codes of n-grams, in order."""

    letters: np.ndarray
    grams: np.ndarray

    @functools.cached_property
    def _symbols(self) -> np.ndarray:
        """By code point: 0 if no letter, 1 and more for those of the alphabet, the last for all others."""
        table = np.where(_is_letter(), len(self.letters) + 1, 0).astype(np.uint8)
        table[self.letters] = np.arange(1, len(self.letters) + 1)
        return table

    @property
    def base(self) -> int:
        return len(self.letters) + 2

    @functools.cached_property
    def _columns(self) -> np.ndarray:
        """By code of an n-gram: its column, or the one after the last."""
        table = np.full(self.base + self.base**2 + self.base**3, len(self.grams), np.int32)
        table[self.grams] = np.arange(len(self.grams))
        return table

    def codes(self, points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, code of an n-gram) for all n-grams of all texts, piece by piece; what is between words is one gap."""
        symbols = self._symbols[points]
        text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        keep = symbols != 0
        keep[1:] |= (symbols[:-1] != 0) & (text[1:] == text[:-1])
        symbols, text, b = symbols[keep], text[keep], self.base
        for at in range(0, len(symbols), PIECE):
            # two symbols of the piece before go in again, so that no n-gram is cut
            s, t = symbols[max(0, at - 2) : at + PIECE].astype(np.int32), text[max(0, at - 2) : at + PIECE]
            yield t, s
            same = t[1:] == t[:-1]
            pair = b + s[:-1] * b + s[1:]
            yield t[1:][same], pair[same]
            same = t[2:] == t[:-2]
            yield t[2:][same], (b + b * b + (pair[:-1] - b) * b + s[2:])[same]

    def presence(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts x n-grams) whether each occurs."""
        seen = np.zeros((len(bounds) - 1, len(self.grams) + 1), bool)
        for text, code in self.codes(points, bounds):
            seen[text, self._columns[code]] = True
        return seen[:, :-1]


def _unit(seen: np.ndarray) -> np.ndarray:
    """Rows of a presence matrix over the root of their sums, so that products of rows are kernel values."""
    rows = seen.astype(np.float32)
    return rows / np.sqrt(np.maximum(1, rows.sum(1)))[:, None]


def _texts(batch: pa.RecordBatch, name: str, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, code points, bounds) of blocks of rows."""
    column = batch.column(name)
    ends = flat_text(column)[1]
    for first, last in blocks(ends, size):
        for a in range(first, last, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, last)
            yield a, b, *code_points(column.slice(a, b - a))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE) -> DataFrame:
    """(lang, rank, text): of each language and class of hashes the different texts of smallest hash; held-out documents are left out.

    Only hashes are ranked, and no task ranks all hashes of a language.
    """
    usable = (~held_out(F.col(id_col))) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    rows = docs.where(usable).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    share = Window.partitionBy("lang", F.pmod("h", F.lit(SHARES))).orderBy("h")
    few = rows.select("lang", "h").distinct().withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= max(1, per_language // SHARES))
    chosen = settle(few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))), "sampled-hashes")
    return rows.join(broadcast_if_small(chosen), ["lang", "h"]).groupBy("lang", "h", "rank").agg(F.min("text").alias("text")).select("lang", "rank", "text")


def _alphabet(sample: DataFrame, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for _, _, points, _ in _texts(batch, "text"):
                total += np.bincount(points, minlength=0x110000)
        found = np.flatnonzero(total * _is_letter())
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["point", "n"])

    counts = sample.select("text").mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["point"] for r in counts.orderBy(F.desc("n"), "point").limit(size).collect()), np.int64)


def _counted(sample: DataFrame, letters: np.ndarray, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, total = Spectrum(letters, np.zeros(0, np.int64)), None
        total = np.zeros(spectrum.base + spectrum.base**2 + spectrum.base**3, np.int64)
        for batch in batches:
            for _, _, points, bounds in _texts(batch, "text"):
                for text, code in spectrum.codes(points, bounds):
                    # once a text and piece, which is enough to rank n-grams by
                    total += np.bincount(np.unique(text.astype(np.int64) * len(total) + code) % len(total), minlength=len(total))
        total[0] = total[spectrum.base] = total[spectrum.base + spectrum.base**2] = 0  # gaps alone
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    counts = sample.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(size).collect()), np.int64)


@dataclass(frozen=True)
class Model:
    """``weights``: n-grams x languages."""

    languages: list[str]
    spectrum: Spectrum
    weights: np.ndarray

    def decide(self, seen: np.ndarray) -> np.ndarray:
        """(texts x languages) of a presence matrix: values near 1 for the language and near -1 for the others."""
        return _unit(seen) @ self.weights


def fit(sample: DataFrame, alphabet: int = ALPHABET, grams: int = GRAMS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of a settled ``sample`` (lang, rank, text); None if the sample is empty."""
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    sample = settle(sample.repartition(TASKS, "lang", "rank"), "dealt-sample")
    letters = _alphabet(sample, alphabet)
    spectrum = Spectrum(letters, _counted(sample, letters, grams))
    n_grams, n_classes = len(spectrum.grams), len(languages)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, points, bounds in _texts(batch, "text"):
                bits = np.packbits(spectrum.presence(points, bounds), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in bits], pa.binary())], ["bits"])

    chosen = sample.where(F.col("rank") <= max(1, landmarks // n_classes)).orderBy("lang", "rank").select("text")
    rows = [np.frombuffer(r["bits"], np.uint8) for r in chosen.mapInArrow(pack, "bits binary").collect()]
    marks = _unit(np.unpackbits(np.stack(rows), axis=1, count=n_grams).astype(bool))
    place = {name: k for k, name in enumerate(languages)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, sums, n = np.zeros((len(marks), len(marks))), np.zeros((len(marks), n_classes)), 0
        for batch in batches:
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b, points, bounds in _texts(batch, "text"):
                near = (_unit(spectrum.presence(points, bounds)) @ marks.T).astype(np.float64)
                goal = np.where(own[a:b, None] == np.arange(n_classes), 1.0, -1.0)
                squares, sums, n = squares + near.T @ near, sums + near.T @ goal, n + b - a
        yield pa.RecordBatch.from_arrays([pa.array([squares.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([n])], ["squares", "sums", "n"])

    squares, sums, n = np.zeros((len(marks), len(marks))), np.zeros((len(marks), n_classes)), 0
    for r in sample.mapInArrow(add, "squares binary, sums binary, n long").toLocalIterator():
        squares, sums, n = squares + np.frombuffer(r["squares"]).reshape(squares.shape), sums + np.frombuffer(r["sums"]).reshape(sums.shape), n + r["n"]
    between = (marks @ marks.T).astype(np.float64)
    coefficients = np.linalg.lstsq(squares + ridge * n * between + 1e-9 * n * np.eye(len(marks)), sums, rcond=None)[0]
    return Model(languages, spectrum, (marks.T @ coefficients).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    best, score = (fresh(c, docs.columns) for c in ("lang_pred", "score"))
    if model is None:
        return docs.withColumns({best: F.lit(UNKNOWN), score: F.lit(0.0)})
    names = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, sure = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, points, bounds in _texts(batch, text_col):
                values = model.decide(model.spectrum.presence(points, bounds))
                letters = np.concatenate([[0], np.cumsum(_is_letter()[points])])
                lettered = letters[bounds[1:]] > letters[bounds[:-1]]
                which[a:b] = np.where(lettered, values.argmax(1), len(names) - 1)
                sure[a:b] = np.where(lettered, np.clip((1 + values.max(1)) / 2, 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([names[k] for k in which], pa.string()), pa.array(sure)], [*batch.schema.names, best, score])
        release()

    fields = [*docs.schema.fields, StructField(best, StringType()), StructField(score, DoubleType())]
    return docs.mapInArrow(run, StructType(fields))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without its text, with held_out, lang_pred and score; learned from those documents that aren't held out."""
    model = fit(settle(training_sample(docs, id_col, text_col, lang_col), "language-sample"))
    out = fresh("held_out", docs.columns)
    return predict(docs, model, text_col).withColumn(out, held_out(F.col(id_col))).drop(text_col)


__all__ = ["Model", "Spectrum", "fit", "held_out", "identify", "predict", "training_sample"]
