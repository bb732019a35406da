"""What each filter of a chain removes, whatever their order: failure masks, exact copies, all permutations.

A row gets a mask with a bit for each of five conditions. Four are columns of
the text. The fifth, being the copy of a text of smaller id, comes by partition
refinement: rows are split by their length in code points, then by the hash of
one block after the other (each block is eight times as long as the one
before), and classes of a single row are dropped before the next block. Whole
texts are compared only where all blocks agree: each with the text of its class's
smallest id, and texts that differ from it (two texts of equal hashes) are a
class of their own in the next round, so hashes decide nothing.

All that the orders need are counts by part and mask, at most 32 a part.

Cases: a null text is empty; an empty text fails only A, and E where another
empty one has a smaller id. A null id is no smaller than any and has no smaller
one. Rows that are equal in id and text don't mark each other. A row of
``labels`` without id counts for nothing, of several rows of an id any 1 counts.
No documents, no rows. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.session import broadcast_if_small, drop_settled, settle

FILTERS = "ABCDE"
#: The bit of the condition that needs other rows.
COPY = 1 << FILTERS.index("E")
#: Code points of the first block, and how many times longer each next one is.
BLOCK, GROWTH = 256, 8
#: Start and length of the blocks; together they are longer than any string can be.
BLOCKS = [(BLOCK * (GROWTH**k - 1) // (GROWTH - 1), min(BLOCK * GROWTH**k, 2**31 - 1)) for k in range(10) if BLOCK * (GROWTH**k - 1) // (GROWTH - 1) < 2**31]

_WORD = r"[^\x20\x09-\x0D]+"


def own_failures(text: Column, words: Column) -> Column:
    """The bits of A to D of a text and of its list of words."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def block_hashes(text: Column) -> Column:
    """Hashes of the successive blocks that the text has."""
    n = F.length(text)
    each = (F.when(n > at, F.xxhash64(F.substring(text, at + 1, size))) for at, size in BLOCKS)
    return F.filter(F.array(*each), lambda h: h.isNotNull())


def _class(n: Column, hashes: Column, level: int | None = None) -> Column:
    """The class of a row by its length and its first ``level`` blocks, or all of them."""
    used = hashes if level is None else F.slice(hashes, 1, level)
    return F.xxhash64(n, used)


def surviving_classes(rows: DataFrame) -> DataFrame:
    """(k, low): classes of two rows or more that agree in length and all blocks, with their smallest id.

    ``rows``: (id, n, h). Each level counts classes with partial aggregates and
    joins the counts back, so a class of very many rows can be split.
    """
    live = rows.where("id is not null").select("id", "n", "h")
    for level in range(len(BLOCKS) + 1):
        live = live.withColumn("k", _class(F.col("n"), F.col("h"), level))
        shared = settle(live.groupBy("k").agg(F.count("*").alias("rows")).where("rows > 1").select("k"), "classes")
        after = settle(live.join(broadcast_if_small(shared, 16), "k", "left_semi").drop("k"), "refined")
        if level:
            drop_settled(live)
        drop_settled(shared)
        live = after
        if not live.where(F.size("h") > level).limit(1).count():
            break
    return live.groupBy(_class(F.col("n"), F.col("h")).alias("k")).agg(F.min("id").alias("low"), F.count("*").alias("rows")).where("rows > 1").select("k", "low")


def copies(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, text, n, h, ...) whose text is that of a row of smaller id.

    ``classes``: (k, low). Only rows of these classes are moved, by class and with their texts.
    """
    classes = broadcast_if_small(settle(classes, "survivors"), 32)
    keyed = texts.where("id is not null").withColumn("k", _class(F.col("n"), F.col("h"))).drop("n", "h")
    rest, found = settle(keyed.join(classes, "k"), "suspects"), None
    while True:
        first = settle(rest.where("id = low").groupBy("k").agg(F.min("text").alias("first")), "first-texts")
        met = rest.join(first, "k")
        marked = met.where("text = first and id > low").drop("k", "low", "first")
        found = marked if found is None else found.union(marked)
        other = met.where("text <> first").drop("low", "first")
        if not other.limit(1).count():
            return found
        other = settle(other, "others")
        rest = settle(other.join(other.groupBy("k").agg(F.min("id").alias("low")), "k"), "suspects")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and by the set of conditions that they fail."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    slim = docs.select(F.col(id_col).alias("id"), part, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = slim.withColumns({"n": F.length("text"), "h": block_hashes(F.col("text"))})
    mask = lambda df: df.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).withColumn("mask", own_failures(F.col("text"), F.col("words")))
    rows = settle(mask(whole).select("id", "part", "n", "h", "mask"), "masks")
    # each row counts once with the bits of its own text; a copy is taken from there and put where the bit of E is set
    moved = F.explode(F.array(F.struct("mask", F.lit(-1).alias("w")), F.struct((F.col("mask") + COPY).alias("mask"), F.lit(1).alias("w"))))
    marked = mask(copies(whole, surviving_classes(rows))).select("id", "part", moved.alias("x")).select("id", "part", "x.mask", "x.w")
    masks = rows.select("id", "part", "mask", F.lit(1).alias("w")).union(marked)
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").groupBy("id").agg(flag("quality"), flag("toxic"))
    total = lambda c, name: F.sum(F.col("w").cast("long") * F.coalesce(F.col(c), F.lit(0))).alias(name)
    counts = masks.join(known, "id", "left").groupBy("part", "mask")
    return counts.agg(F.sum(F.col("w").cast("long")).alias("n"), total("quality", "good"), total("toxic", "toxic"))


def _steps() -> Column:
    """Every step of every order, as a constant array of (filter_order, step, before, bit)."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "before": before, "bit": 1 << k})
            before |= 1 << k
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters."""
    counts = failure_counts(docs, labels, **columns)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(_steps()).alias("s")).select("part", "masks", "s.*")
    before, bit = F.col("before"), F.col("bit")

    def over(value: Callable[[Column], Column], which: Callable[[Column], Column]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(which(x["mask"]), value(x)).otherwise(0).cast("long"))

    fails, passed = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) == 0)
    n, removed = (lambda x: x["n"]), (lambda m: fails(m) & passed(m))
    orders = math.factorial(len(FILTERS))
    return rows.select(
        "part", "filter_order", "step", over(n, lambda m: passed(m) & ~fails(m)).alias("kept"), over(n, removed).alias("removed"), over(n, lambda m: fails(m) & ~passed(m)).alias("redundant"),
        over(n, lambda m: m == bit).alias("unique_fails"), over(lambda x: x["good"], removed).alias("good_lost"), over(lambda x: x["toxic"], removed).alias("toxic_lost"),
        # of the orders, those count in which the filter comes before all others that the row fails
        over(lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long"), fails).alias("shapley"),
    )
