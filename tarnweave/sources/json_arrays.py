"""Files of one JSON array, or one object of records, read in parallel by blocks, whatever their size.

Spark's text reader cuts the files at commas and deals the pieces out by blocks of
the file, from any file system. What a comma is, between records or within one,
depends on all text before it, but only by two facts: whether it lies in a string,
and how deep. A first pass finds, for each block, how it changes both (for either
start); sums over a file's blocks, a row each, give every block's own start; the second pass
then cuts records, and those that span blocks are put together by their few parts.

A file that ends between records gives those that it has. One that ends within a
record or in an object, holds anything else than an array or object, has text after
an object, or a record that isn't JSON, is an error that names it. Text after an
array, empty places between commas, a byte order mark and blank files are passed over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnweave.session import settle

_NEVER = 1 << 40
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_BLOCK = "file string, block long"
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value) in the order of each block, cut at commas."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], dict, list[bytes]]]:
    """(file and block, the other columns' first values, pieces) of rows that follow one another."""
    for batch in batches:
        if not len(batch):
            continue
        file, block = batch.column("file"), batch.column("block")
        values, others = batch.column("value").cast(pa.binary()).to_pylist(), [n for n in batch.schema.names if n not in ("file", "block", "value")]
        # a block's rows follow one another, so it is only where they change that keys are looked at
        change = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist()]
        for at, end in zip(starts, [*starts[1:], len(batch)], strict=True):
            yield (file[at].as_py(), block[at].as_py()), {c: batch.column(c)[at].as_py() for c in others}, values[at:end]


def _signs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, places of brackets and braces, and by how much each of these changes the depth."""
    plain = np.frombuffer(_ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
    step = _STEP[plain]
    signs = np.flatnonzero(step)
    return np.flatnonzero(plain == 0x22), signs, step[signs].astype(np.int64)


def _open(quotes: np.ndarray, places: np.ndarray, in_string: bool) -> np.ndarray:
    """Whether a string is open at places, a quote counting from its own place on."""
    return (np.searchsorted(quotes, places, "right") + in_string) % 2 == 1


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: for a start outside (0) and inside (1) a string the change in depth and the least depth after a closing sign."""
    seen: dict[tuple[str, int], list] = {}
    for key, _, values in _runs(batches):
        data = b",".join(values) + b","
        state = seen.setdefault(key, [b"", 0, 0, 0, _NEVER, _NEVER])
        state[0] = state[0] or data[:-1].lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
        quotes, signs, step = _signs(data)
        inside = _open(quotes, signs, bool(state[1]))
        for k in (0, 1):
            own = step[inside == bool(k)]
            depth = np.cumsum(own)
            if (own < 0).any():
                state[4 + k] = min(state[4 + k], state[2 + k] + int(depth[own < 0].min()))
            state[2 + k] += int(own.sum())
        state[1] ^= len(quotes) % 2
    rows = [(file, block, s[0].decode("latin-1"), *s[1:]) for (file, block), s in seen.items()]
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("sign", pa.string()), *((n, pa.int64()) for n in ("flips", "delta0", "delta1", "low0", "low1"))])
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _starts(pieces: DataFrame) -> DataFrame:
    """(file, block, kind, quoted, depth, closed, ...): how each block begins, a row a block; faults are raised."""
    found = settle(pieces.mapInArrow(_survey, f"{_BLOCK}, sign string, flips long, delta0 long, delta1 long, low0 long, low1 long"), "json-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("quoted", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumns({"delta": F.when(F.col("quoted"), F.col("delta1")).otherwise(F.col("delta0")), "low": F.when(F.col("quoted"), F.col("low1")).otherwise(F.col("low0"))})
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    rows = rows.withColumns({"closes": F.col("depth") + F.col("low") <= 0, "kind": F.first(F.when(F.col("sign") != "", F.col("sign")), ignorenulls=True).over(until)})
    rows = rows.withColumn("closed", F.coalesce(F.max("closes").over(before), F.lit(False)))
    rows = settle(rows.withColumn("more", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNotNull()), "json-starts")
    ends = rows.where("not more and not closed and not closes and kind is not null")
    open_string = F.col("quoted") != (F.col("flips") % 2 == 1)
    wrong = rows.where(~F.col("kind").isin("[", "{")).select("file", F.lit("is no JSON array or object").alias("why"))
    cut = ends.where(open_string | (F.col("depth") + F.col("delta") > 1) | (F.col("kind") == "{")).select("file", F.lit("ends within a record").alias("why"))
    fault = wrong.union(cut).orderBy("file").first()
    if fault:
        raise ValueError(f"{fault['file']} {fault['why']}")
    return rows.select("file", "block", "kind", "quoted", "depth", "closed")


@dataclass
class _Cutter:
    """Cuts one block's records; parts that begin before the block or don't end in it come out as such."""

    file: str
    block: int
    kind: str | None
    quoted: bool
    depth: int
    closed: bool

    def __post_init__(self) -> None:
        self.begun = self.depth == 0  # in front of the file's first sign, so that the first record begins here
        self.open: list[bytes] = []
        self.count = 0

    def row(self, raw: bytes | None, ended: bool) -> dict:
        """A record or a part of one; None where a block ends between records, which is no part."""
        head = not self.begun
        out = {"file": self.file, "block": self.block, "k": self.count, "head": head, "tail": not ended, "raw": raw if raw is None else raw.decode("utf-8")}
        self.begun, self.count, self.open = True, self.count + 1, []
        return out

    def cut(self, values: list[bytes]) -> Iterator[dict]:
        if self.closed:
            self.after(b",".join(values))
            return
        data = b",".join(values) + b","
        quotes, signs, step = _signs(data)
        plain = ~_open(quotes, signs, self.quoted)
        signs, depth = signs[plain], self.depth + np.cumsum(step[plain])
        start = 0
        if self.depth == 0:
            first = np.flatnonzero(depth > 0)
            if not len(first):
                return
            start = int(signs[first[0]]) + 1
        falls = signs[(depth <= 0) & (signs >= start)]
        stop = int(falls[0]) if len(falls) else len(data)
        ends = np.cumsum([len(v) + 1 for v in values]) - 1
        ends = ends[(ends >= start) & (ends < stop)]
        at_depth = np.concatenate([[self.depth], depth])[np.searchsorted(signs, ends)]
        for at in ends[~_open(quotes, ends, self.quoted) & (at_depth == 1)]:
            yield self.row(b",".join([*self.open, data[start:at]]), True)
            start = int(at) + 1
        if stop < len(data):
            yield self.row(b",".join([*self.open, data[start:stop]]), True)
            self.closed = True
            self.after(data[stop + 1 : -1])
        elif start < len(data):
            self.open.append(data[start:-1])
        self.quoted, self.depth = bool((len(quotes) + self.quoted) % 2), int(depth[-1]) if len(depth) else self.depth

    def after(self, rest: bytes) -> None:
        if self.kind == "{" and rest.strip():
            raise ValueError(f"{self.file} has text after its object")

    def end(self) -> Iterator[dict]:
        if not self.closed and self.kind is not None:
            yield self.row(b",".join(self.open) if self.open else None, False)


_PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()), ("raw", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter: _Cutter | None = None
    for key, start, values in _runs(batches):
        rows: list[dict] = []
        if cutter is None or (cutter.file, cutter.block) != key:
            rows += cutter.end() if cutter else ()
            cutter = _Cutter(*key, **start)
        rows += cutter.cut(values)
        yield pa.RecordBatch.from_pylist(rows, _PARTS)
    if cutter:
        yield pa.RecordBatch.from_pylist(list(cutter.end()), _PARTS)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that are JSON; of an object's records the values."""
    decode = json.JSONDecoder().raw_decode
    for batch in batches:
        out = []
        for file, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "kind", "raw")), strict=True):
            value = raw.strip("﻿ \t\r\n")
            if not value:
                out.append(None)
                continue
            try:
                if kind == "{":
                    _, at = decode(value)
                    value = value[at:].lstrip().removeprefix(":").strip()
                json.loads(value)
            except ValueError as e:
                raise ValueError(f"{file} has a record that isn't JSON: {raw[:60]!r}") from e
            out.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("place"), pa.array(out, pa.string())], ["file", "place", "_raw"])


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, _raw): the JSON text of every record of files that hold an array or an object of records.

    ``place`` grows with the order in the file. The first pass runs at once and
    raises for files that are cut off; a broken record is an error when rows are read.
    """
    pieces = _pieces(spark, path)
    # a row a block of the files, which is a hundred bytes for a hundred megabytes
    starts = _starts(pieces)
    rows = pieces.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "kind", "quoted", "depth", "closed", "value")
    parts = settle(rows.mapInArrow(_cut, T.StructType.fromDDL(f"{_BLOCK}, k long, head boolean, tail boolean, raw string")), "json-records")
    whole = parts.where("not head and not tail").select("file", (F.col("block") + F.col("k")).alias("place"), "raw")
    # a record that spans blocks begins in a tail that is no head; at most two rows a block
    order = Window.partitionBy("file").orderBy("block", "k")
    spans = parts.where("head or tail").withColumn("group", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order)).groupBy("file", "group")
    joined = spans.agg(F.min(F.col("block") + F.col("k")).alias("place"), F.array_sort(F.collect_list(F.struct("block", "k", "raw"))).alias("parts"))
    joined = joined.select("file", "place", F.array_join(F.transform("parts", lambda p: p["raw"]), ",").alias("raw"))
    kinds = F.broadcast(starts.groupBy("file").agg(F.max("kind").alias("kind")))
    return whole.union(joined).join(kinds, "file").mapInArrow(_checked, "file string, place long, _raw string").where("_raw is not null")


def json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The records of such files with a given schema; the JSON text of each is kept as ``_raw``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return array_items(spark, path).select("place", "_raw", F.from_json("_raw", kind).alias("r")).select("place", "_raw", "r.*")
