"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most
``max_bits`` (3) of them. For every distinct fingerprint the Hamming distances to
``PIVOTS`` reference fingerprints are computed once. By the triangle inequality
two linked fingerprints have nearly the same distance to each pivot, so a pair
whose distances to any pivot differ by more than ``max_bits`` is discarded; the
survivors are verified by counting the bits that differ.

Distances of 64-bit hashes lie close around 32, so pivots alone leave about half
of all pairs each and can't spread pairs over a cluster. The pairs that the
tables are asked about come from blocks that lose no link: the bits fall into
five groups, and of five groups at least two are equal in a linked pair. Blocks
of more than ``BLOCK_ROWS`` are divided by four groups of the bits that aren't fixed
yet, one of which must be equal, and again, up to three times. Within a block the
first pivot's distances are the order in which a fingerprint's candidates are found:
only those within ``max_bits`` of its own are looked at. A block yields a spanning
forest of its links and not all of them, so a dense block of n fingerprints gives at
most n - 1 rows.

Defined cases: null and empty texts have fingerprint zero and are linked like any
other; repeated rows have one fingerprint and one component; a null id is passed
over when the smallest id is sought; an empty table gives an empty result; other
columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm._arrow import release
from tarnweave.llm._graph import components
from tarnweave.session import broadcast_if_small, settle

#: Number of reference fingerprints.
PIVOTS = 16
#: Bit groups (first bit, bits) of which a linked pair shares two.
GROUPS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows above which a block is divided.
BLOCK_ROWS = 20_000
#: Four groups of all bits, by every first, fourth and sixteenth bit, that blocks are divided by in turn.
STRIPES = [[sum(1 << b for b in range(64) if b // step % 4 == q) for q in range(4)] for step in (1, 4, 16)]
#: Blocks up to this size are compared pair by pair, larger ones by search.
SMALL_BLOCK = 48
#: Shingles that are hashed at once.
PIECE = 32_768

SPACE = b" \t\n\r\x0b\x0c"


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: XXH64 of 0, 1, ..."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(str(k).encode(), 42) for k in range(n)], np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned number."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z and only ASCII space
    if not words:
        return 0
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        h = [digest(flat[a:b], 42) for a, b in zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce((ones * 2 > len(starts)).astype(np.uint64) << np.arange(64, dtype=np.uint64)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, h, fp): h tells texts of one id apart, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint((t or "").encode(), shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], batch.column(2), pa.array(fp.view(np.int64))], names=["id", "h", "fp"])
        release()

    kind = df.schema[id_col].dataType.simpleString()
    body = F.col(text).cast("string")
    return df.select(F.col(id_col).alias("id"), body, text_hash(body)).mapInArrow(run, f"id {kind}, h long, fp long")


def _with_pivots(fps: DataFrame) -> DataFrame:
    """``fps`` with the pivot table: the distance to each reference fingerprint, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in table], pa.binary())], names=["fp", "pivots"])

    return fps.select("fp").mapInArrow(run, "fp long, pivots binary")


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray | int, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are linked: pivots discard, the differing bits verify."""
    alive = np.flatnonzero((np.abs(table[i, 0] - table[j, 0]) <= max_bits))
    for k in range(1, table.shape[1], 5):
        ii = i if np.isscalar(i) else i[alive]
        alive = alive[(np.abs(table[ii, k : k + 5] - table[j[alive], k : k + 5]).max(axis=1, initial=0) <= max_bits)]
    ii = i if np.isscalar(i) else i[alive]
    return alive[np.bitwise_count(fp[ii] ^ fp[j[alive]]) <= max_bits]


def _search(fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of one block's links; rows are in the order of the first pivot's distance."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            lo, hi = np.searchsorted(table[rest, 0], [table[i, 0] - max_bits, table[i, 0] + max_bits + 1])
            found = lo + _near(fp, table, i, rest[lo:hi], max_bits)
            near = rest[found].tolist()
            a += [i] * len(near)
            b += near
            front += near
            rest = np.delete(rest, found)
    return a, b


def _links_of_blocks(key: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted blocks: lag by lag for small blocks, by search for large ones."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    a, b = [], []
    small = np.repeat(size <= SMALL_BLOCK, size)
    for lag in range(1, SMALL_BLOCK):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:]) if lag < len(key) else np.zeros(0, int)
        if not len(i):
            break
        linked = i[_near(fp, table, i, i + lag, max_bits)]
        a.append(fp[linked])
        b.append(fp[linked + lag])
    for at, n in zip(first[size > SMALL_BLOCK], size[size > SMALL_BLOCK], strict=True):
        x, y = _search(fp[at : at + n], table[at : at + n], max_bits)
        a.append(fp[at : at + n][x])
        b.append(fp[at : at + n][y])
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that can reach each other."""
    if max_bits > 3:
        raise ValueError("the bit groups are made for at most 3 differing bits")
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    blocks = []
    for i, j in combinations(range(5), 2):
        fixed = sum(((1 << n) - 1) << at for at, n in (GROUPS[i], GROUPS[j]))
        blocks.append(F.struct(F.xxhash64(F.lit(f"{i},{j}"), F.col("fp").bitwiseAND(signed(fixed))).alias("key"), signed((1 << 64) - 1 - fixed).alias("free")))
    rows = settle(_with_pivots(fps), "pivots").select(F.explode(F.array(*blocks)).alias("block"), "fp", "pivots").select("block.key", "block.free", "fp", "pivots")
    for stripes in STRIPES:
        large = settle(rows.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key"), "large-blocks")
        if not large.limit(1).count():
            break
        hinted = broadcast_if_small(large, 16)
        # three bits can't touch all of four groups
        finer = [F.struct(F.xxhash64(F.lit(q), "key", F.col("fp").bitwiseAND(F.col("free")).bitwiseAND(signed(m))).alias("key"), F.col("free").bitwiseAND(signed((1 << 64) - 1 - m)).alias("free")) for q, m in enumerate(stripes)]
        divided = rows.join(hinted, "key", "left_semi").select(F.explode(F.array(*finer)).alias("block"), "fp", "pivots").select("block.key", "block.free", "fp", "pivots")
        rows = settle(rows.join(hinted, "key", "left_anti").union(divided), "divided-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fp, flat):
            table = np.frombuffer(b"".join(flat), np.uint8).reshape(-1, PIVOTS).astype(np.int8)
            a, b = _links_of_blocks(key, fp, table, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple] = []  # rows of the last key, which may go on in the next batch
        for batch in batches:
            key, fp, flat = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_pylist()
            if not len(key):
                continue
            if held and held[-1][0][-1] != key[0]:
                yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])
                held = []
            cut = int(np.flatnonzero(key == key[-1])[0])
            cut = int(np.searchsorted(key, key[-1])) if cut else 0
            if cut:
                held.append((key[:cut], fp[:cut], flat[:cut]))
                yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])
                held = []
            held.append((key[cut:], fp[cut:], flat[cut:]))
        if held:
            yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])

    dealt = rows.select("key", "fp", "pivots").repartition("key").sortWithinPartitions("key", F.substring("pivots", 1, 1), "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rooted(df: DataFrame, text: str, id_col: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, least, root) of the distinct ones."""
    rows = settle(fingerprints(df, text, id_col), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, max_bits)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, settle(rooted, "roots")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """(id, fingerprint in hex, component_id: the smallest id that links reach)."""
    rows, rooted = _rooted(df, text, id_col, max_bits)
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least-of-component")
    found = settle(rooted.join(broadcast_if_small(least), "root").select("fp", "component_id"), "component-of-fingerprint")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """One row of each component with its columns: that of the smallest id, of equal ids that of the least text hash.

    Of rows that repeat both id and text one stays too; only those rows, if
    there are any, are brought together to choose among them.
    """
    rows, rooted = _rooted(df, text, id_col, max_bits)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    firsts = rows.groupBy("fp", "id", "h").agg(F.count("*").alias("n")).groupBy("fp").agg(F.min(F.struct(place.alias("at"), "n")).alias("first"))
    firsts = firsts.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    firsts = settle(firsts.select(F.col("first.at.id").alias("_id"), F.col("first.at.h").alias("_h"), F.col("first.n").alias("_n")), "first-of-component")

    def chosen(of: DataFrame) -> DataFrame:
        of = broadcast_if_small(of.select("_id", "_h"), 32, 500_000)
        return df.join(of, df[id_col].eqNullSafe(of["_id"]) & (text_hash(df[text].cast("string")) == of["_h"]), "left_semi")

    once, repeated = firsts.where("_n = 1"), firsts.where("_n > 1")
    if not repeated.limit(1).count():
        return chosen(once)
    own = "_key"
    while own in df.columns:
        own += "_"
    several = chosen(repeated).withColumn(own, F.struct(F.col(id_col), text_hash(F.col(text).cast("string"))))
    return chosen(once).unionByName(several.dropDuplicates([own]).drop(own))
