"""BPE encoding and decoding by batched numpy merge rounds.

A vocabulary file in the JSON form of byte-level BPE is read once per Python
worker. Texts are split at added tokens and then into words by the byte-level
pattern. Words that a worker has not met yet are encoded together: their symbols
lie in one flat array, every round looks all neighbouring pairs up by binary
search over the sorted pair keys, takes each word's lowest rank, and merges all
of its occurrences from the left. Words without a mergeable pair leave the array.

Nulls count as empty texts; an empty text has no tokens. Rows are independent:
repeated rows, ties of ids and further columns pass through untouched; a result
whose name the table has already gets an underscore before it. A very long text is encoded piece by piece, so a task's
memory follows one piece and not the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnweave.llm._arrow import release
from tarnweave.llm._names import fresh

#: The word pattern of byte-level BPE, a fixed value; white space is Unicode's property.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words that a task remembers before it starts anew, and the longest word that it remembers.
CACHE_WORDS, CACHE_WORD = 65_536, 64
#: Words of one text that are encoded at once.
PIECE_WORDS = 32_768
#: Rows that are encoded together.
SLICE = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Bpe:
    """The codec of one vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.base = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        of_byte = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = [b""] * self.base
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_byte[c] for c in token) if all(c in of_byte for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * self.base + right, kind="stable")
        self.keys, self.ranks = (left * self.base + right)[order], order.astype(np.int64)
        self.made = made
        self.words = regex.compile(WORD_PATTERN)
        self.splitter = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.ints = list(range(self.base))  # one object a token, which all cached words share
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out: list[tuple[int, ...]] = [()] * len(words)
        none = np.int64(len(self.made))
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.r_[first, len(owner)])
            if (over := best == none).any():
                for k in np.flatnonzero(over):
                    out[owner[first[k]]] = tuple(symbols[first[k] : first[k] + span[k]].tolist())
                stay = np.repeat(~over, span)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                best, span = best[~over], span[~over]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, span)
            # of a run of overlapping hits, each second one counts, from the left
            begin = hit & ~np.r_[False, hit[:-1]]
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit &= run % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            keep = ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        return out

    def encoded(self, words: list[str]) -> Iterator[tuple[str, tuple[tuple[int, ...], str]]]:
        """Each word with its ids and their digits, by one call of ``merge``."""
        for w, ids in zip(words, self.merge([w.encode("utf-8", "surrogatepass") for w in words]), strict=True):
            yield w, (tuple(map(self.ints.__getitem__, ids)), ",".join(map(str, ids)))

    def learn(self, words: set[str]) -> None:
        """Put words that aren't too long into the cache, which is emptied first if they don't fit."""
        fresh = [w for w in words.difference(self.cache) if len(w) <= CACHE_WORD]
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = [w for w in words if len(w) <= CACHE_WORD]
        self.cache.update(self.encoded(fresh))

    def joined(self, words: list[str]) -> tuple[list[int], str]:
        """The ids of words in a row, and their digits with commas between."""
        try:
            got = list(map(self.cache.__getitem__, words))
        except KeyError:
            kinds = set(words)
            self.learn(kinds)
            long = dict(self.encoded(list(kinds.difference(self.cache))))
            got = [self.cache.get(w) or long[w] for w in words]
        return [i for ids, _ in got for i in ids], ",".join([digits for _, digits in got])

    def pieces(self, text: str) -> Iterator[tuple[list[int], str]]:
        """A text's ids and digits, piece by piece."""
        for k, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if k % 2:
                yield [self.added[part]], str(self.added[part])
                continue
            found = (m[0] for m in self.words.finditer(part))
            while words := list(islice(found, PIECE_WORDS)):
                yield self.joined(words)

    def batch(self, texts: list[str | None]) -> Iterator[Iterable[tuple[list[int], str]]]:
        """The pieces of each text; the new words of all short texts are encoded together."""
        split = [self.words.findall(t) if t and len(t) < PIECE_WORDS and not any(c in t for c in self.added) else None for t in texts]
        self.learn(set().union(*(w for w in split if w)))
        for t, words in zip(texts, split, strict=True):
            yield self.pieces(t or "") if words is None else [self.joined(words)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def codec(vocabulary: str) -> Bpe:
    """The worker's codec. Tasks of a worker share its tables; the words of a task go with it (see ``_mapped``)."""
    return Bpe(vocabulary)


def _mapped(df: DataFrame, vocabulary: str, column: str, fields: list[T.StructField], make: Callable[[Bpe, list], list[pa.Array]]) -> DataFrame:
    """``df`` with new columns that ``make`` computes from one column of a batch.

    A new column whose name ``df`` has already gets underscores before it, so none of the caller's is lost.
    """
    made: list[T.StructField] = []
    for f in fields:
        made.append(T.StructField(fresh(f.name, [*df.columns, *(m.name for m in made)]), f.dataType))
    names = [*df.columns, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        try:
            for batch in batches:
                for a in range(0, len(batch), SLICE):
                    part = batch.slice(a, SLICE)
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *make(bpe, part.column(0).to_pylist())], names=names)
        finally:
            bpe.cache = {}  # a reused worker keeps no words of a task that is done
            release()

    given = df.select(df[column].alias(fresh("given", df.columns)), *(df[c] for c in df.columns))
    return given.mapInArrow(run, T.StructType([*df.schema.fields, *made]))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array column ``ids``."""

    def make(bpe: Bpe, texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([[i for ids, _ in pieces for i in ids] for pieces in bpe.batch(texts)], pa.list_(pa.int32()))]

    return _mapped(df, vocabulary, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids; bytes that are no UTF-8 become U+FFFD."""

    def make(bpe: Bpe, rows: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array([bpe.decode(r or []).decode("utf-8", "replace") for r in rows], pa.string())]

    return _mapped(df, vocabulary, ids, [T.StructField(text, T.StringType())], make)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens and the digests of the ids and of the text decoded from them.

    The ids of a text never lie in memory together: each piece is encoded,
    digested and decoded, so very long texts need no more than short ones.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(bpe: Bpe, texts: list[str | None]) -> list[pa.Array]:
        rows = []
        for pieces in bpe.batch(texts):
            n, ids_sha, text_sha, left = 0, hashlib.sha256(), hashlib.sha256(), b""
            for ids, digits in pieces:
                if ids:
                    ids_sha.update(b"," * (n > 0) + digits.encode())
                    n += len(ids)
                    left = _whole(left + bpe.decode(ids), text_sha)
            text_sha.update(left.decode("utf-8", "replace").encode())
            rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
        n, a, b = zip(*rows, strict=True)
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _mapped(df, vocabulary, text, fields, make)


def tokenise(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with ids, n_tokens, and decodes: whether the ids decode to the same text."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decodes", T.BooleanType())]

    def make(bpe: Bpe, texts: list[str | None]) -> list[pa.Array]:
        rows, same = [], []
        for pieces, t in zip(bpe.batch(texts), texts, strict=True):
            parts = [(np.array(ids, np.int32), bpe.decode(ids)) for ids, _ in pieces]
            rows.append(np.concatenate([np.zeros(0, np.int32), *(a for a, _ in parts)]))
            same.append(b"".join(d for _, d in parts) == (t or "").encode())
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *rows]))
        return [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([len(r) for r in rows], pa.int64()), pa.array(same, pa.bool_())]

    return _mapped(df, vocabulary, text, fields, make)


def _whole(data: bytes, sha) -> bytes:
    """Digest ``data`` but for a character that its end may cut, which is returned."""
    cut = len(data)
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 != 0x80:
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            cut -= back if need > back else 0
            break
    sha.update(data[:cut].decode("utf-8", "replace").encode())
    return data[cut:]
