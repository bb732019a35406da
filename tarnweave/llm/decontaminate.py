"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame functions are used. The steps:

1. the benchmark's words are looked up in the corpus: how often does each occur;
   a window with a word that the corpus lacks can't occur and is settled;
2. of every other window the two rarest words become its terms, and the
   postings (term, document, position) of these terms are stored;
3. the postings of an item's terms, less the terms' offsets in the item, are
   intersected: a document and an alignment stay if two terms of the item (one
   if it has a one-word window) fall on the same alignment;
4. the remaining alignments are compared word by word with the documents, which
   gives the exact windows; the intervals of a document are then merged;
5. proximity matches come from the same index: of each item the ``NEAR_TERMS`` (4)
   rarest words that the corpus has are terms too, and a document is near an item
   where ``NEAR_NEED`` (3) of these, or all if the item has fewer, but two at least,
   lie where the item has them, give or take ``SLOP`` (8) words altogether.

Words and windows: A-Z become a-z, words are runs of digits, letters a-z and all
characters beyond ASCII. A window is ``window`` (13) item words in a row; an item
of fewer words, but not none, is one window.

Defined cases: null and empty texts have no words (0 hits, not contaminated);
items with equal texts all count; rows that repeat both id and text get equal
results, rows of one id with other texts their own; an empty benchmark leaves all
documents clean; an empty document table gives an empty result; other columns
are ignored, clashing names included. Positions are those of the whole text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm._names import fresh
from tarnweave.session import broadcast_if_small, settle

#: What lies between words, after A-Z became a-z. A fixed value.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window.
WINDOW = 13
#: Of an item's rarest words in the corpus so many are terms of proximity, so many must lie together, and so close.
NEAR_TERMS, NEAR_NEED, SLOP = 4, 3, 8


def word_list(text: Column) -> Column:
    """The words of a text, lower case as far as ASCII goes."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, GAP), "")


def _keyed(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, h, words): h tells texts of one id apart."""
    text = F.col(text).cast("string")
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), word_list(text).alias("words"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])


def item_words(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, item_words): items that have words; ``item`` numbers the rows."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), word_list(F.col(text).cast("string")).alias("item_words"))
    return rows.where(F.size("item_words") > 0).distinct().select(F.xxhash64("item_id", "item_words").alias("item"), "item_id", "item_words")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of each word that an item has."""
    terms = broadcast_if_small(settle(items.select(F.explode("item_words").alias("term")).distinct(), "item-terms"), 256)
    words = docs.select(F.explode("words").alias("term"))
    return words.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rare_terms(items: DataFrame, counts: DataFrame, window: int = WINDOW, terms: int = 2) -> DataFrame:
    """(item, term, offset, need): the rarest words of each window that can occur.

    ``need`` says how many of an item's terms must fall on one alignment.
    """
    spots = items.select("item", F.size("item_words").alias("length"), F.posexplode("item_words").alias("offset", "term"))
    spots = spots.join(counts, "term", "left").groupBy("item", "length").agg(F.sort_array(F.collect_list(F.struct("offset", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("spots"))
    width = F.least(F.lit(window), F.col("length"))
    windows = F.transform(F.sequence(F.lit(1), F.col("length") - width + 1), lambda at: F.slice("spots", at, width))
    windows = F.filter(windows, lambda w: F.forall(w, lambda s: s["n"] > 0))
    rarest = lambda w: F.slice(F.sort_array(F.transform(w, lambda s: F.struct(s["n"].alias("n"), s["offset"].alias("offset"), s["term"].alias("term")))), 1, terms)
    picked = spots.select("item", F.array_distinct(F.flatten(F.transform(windows, rarest))).alias("picked"), F.least(F.lit(terms), width).alias("need"))
    return picked.select("item", "need", F.explode("picked").alias("p")).select("item", "need", F.col("p.offset").alias("offset"), F.col("p.term").alias("term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, h, position): the positional index of the given terms."""
    terms = broadcast_if_small(settle(terms.select("term").distinct(), "index-terms"), 256)
    words = docs.select("id", "h", F.posexplode("words").alias("position", "term"))
    return words.join(terms, "term", "left_semi")


def alignments(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, h, item, shift): where enough of an item's terms lie as far apart as in the item."""
    terms = broadcast_if_small(settle(terms, "query-terms"), 256)
    moved = index.join(terms, "term").select("id", "h", "item", "need", (F.col("position") - F.col("offset")).alias("shift"))
    together = moved.groupBy("id", "h", "item", "shift").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    # rows that repeat both id and text count a term more than once, which leaves more to verify and loses nothing
    return together.where(F.col("n") >= F.col("need")).select("id", "h", "item", "shift")


def near_terms(items: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS, need: int = NEAR_NEED) -> DataFrame:
    """(item, term, offset, need): the rarest words of each item that the corpus has, wherever the item has them."""
    spots = items.select("item", F.posexplode("item_words").alias("offset", "term")).join(counts, "term")
    rarest = spots.groupBy("item").agg(F.slice(F.array_sort(F.collect_set(F.struct("n", "term"))), 1, terms).alias("rarest")).where(F.size("rarest") > 1)
    rarest = rarest.select("item", F.least(F.lit(need), F.size("rarest")).alias("need"), F.explode("rarest.term").alias("term"))
    return spots.join(rarest, ["item", "term"]).select("item", "term", "offset", "need")


class Index:
    """The benchmark's items and terms, and the stored postings of the documents for them."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_col: str, item_text: str, window: int, near: bool) -> None:
        docs = _keyed(documents, id_col, text)
        self.items = settle(item_words(benchmark, item_col, item_text), "items")
        counts = settle(term_counts(docs, self.items), "term-counts")
        self.rare = settle(rare_terms(self.items, counts, window), "rare-terms")
        self.near = settle(near_terms(self.items, counts), "near-terms") if near else None
        terms = self.rare.select("term").union(self.near.select("term")) if near else self.rare
        self.postings = settle(postings(docs, terms), "postings")


def phrase_matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, index: Index | None = None) -> DataFrame:
    """(id, h, item_id, start, stop): maximal runs of document words inside windows of an item that occur."""
    index = index or Index(documents, benchmark, id_col, text, item_col, item_text, window, near=False)
    found = settle(alignments(index.postings, index.rare), "alignments").join(broadcast_if_small(index.items), "item")
    found = broadcast_if_small(settle(found.select("id", "h", "item_id", "item_words", "shift"), "candidates"))
    # only texts with a candidate are split into words
    body = F.col(text).cast("string")
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), body.alias("body"))
    pairs = docs.join(found, _same(docs, found)).select(docs["id"], docs["h"], word_list(F.col("body")).alias("words"), "item_id", "item_words", "shift")
    # words of the document under the item's first to last word, as far as the document reaches
    length, skip = F.size("item_words"), F.greatest(F.lit(0), -F.col("shift"))
    part = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.greatest(F.lit(0), length - skip))
    own = F.slice("item_words", skip + 1, F.greatest(F.lit(1), length))
    equal = F.zip_with(part, own, lambda a, b: F.coalesce(a == b, F.lit(False)))
    width = F.least(F.lit(window), length)
    base = F.greatest(F.col("shift"), F.lit(0))
    pairs = pairs.select("id", "h", "item_id", equal.alias("equal"), base.alias("base"), width.alias("width"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("equal") - F.col("width"))), lambda s: (s + F.col("width") <= F.size("equal")) & F.forall(F.slice("equal", s + 1, F.col("width")), lambda e: e))
    hits = pairs.select("id", "h", "item_id", "base", "width", starts.alias("starts")).where(F.size("starts") > 0)
    # runs: a start whose predecessor is no start opens one
    opening = F.filter("starts", lambda s: ~F.array_contains("starts", s - 1))
    closing = F.filter("starts", lambda s: ~F.array_contains("starts", s + 1))
    run = F.explode(F.arrays_zip(opening.alias("a"), closing.alias("b"))).alias("run")
    hits = hits.select("id", "h", "item_id", "base", "width", run)
    return hits.select("id", "h", "item_id", (F.col("base") + F.col("run.a")).alias("start"), (F.col("base") + F.col("run.b") + F.col("width")).alias("stop")).distinct()


def proximity_matches(documents: DataFrame, benchmark: DataFrame, slop: int = SLOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", index: Index | None = None) -> DataFrame:
    """(id, h, item_id, position, n_terms): where enough different terms of an item lie as in the item, exact phrases or not.

    A posting's shift is its position less the term's offset in the item.
    ``position`` is a shift from which on, up to ``slop`` more, lie the shifts of
    ``n_terms`` terms; every such shift is a match.
    """
    index = index or Index(documents, benchmark, id_col, text, item_col, item_text, WINDOW, near=True)
    moved = index.postings.join(broadcast_if_small(index.near), "term").select("id", "h", "item", "need", "term", (F.col("position") - F.col("offset")).cast("long").alias("shift"))
    onward = Window.partitionBy("id", "h", "item").orderBy("shift").rangeBetween(0, slop)
    near = moved.withColumn("n_terms", F.size(F.collect_set("term").over(onward)).cast("long")).where("n_terms >= need")
    named = near.join(broadcast_if_small(index.items.select("item", "item_id")), "item")
    return named.select("id", "h", "item_id", F.col("shift").alias("position"), "n_terms").distinct()


def hit_words(hits: DataFrame) -> DataFrame:
    """(id, h, n_hit, items): how many words the intervals of a document cover together; a null item id is an item of its own."""
    before = F.max("stop").over(Window.partitionBy("id", "h").orderBy("start", "stop", "item_id").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    return hits.withColumn("new", new).groupBy("id", "h").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.struct("item_id"))).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row of ``documents``.

    Contaminated: a twentieth of the words or more lie inside windows that occur.
    ``n_near`` is the number of items with a proximity match. Items without an id
    count, as one, and are no part of ``items_sha256``.
    """
    index = Index(documents, benchmark, id_col, text, item_col, item_text, window, near=True)
    hits = settle(phrase_matches(documents, benchmark, id_col, text, item_col, item_text, window, index), "phrase-matches")
    near = proximity_matches(documents, benchmark, SLOP, id_col, text, item_col, item_text, index)
    near = near.groupBy("id", "h").agg(F.count_distinct(F.struct("item_id")).alias("n_near"))
    merged = hit_words(hits)
    merged = merged.select("id", "h", "n_hit", "items", F.lit(0).cast("long").alias("n_near")).union(near.select("id", "h", F.lit(None).cast("long"), F.lit(None).cast("array<struct<item_id:string>>"), "n_near"))
    merged = merged.groupBy("id", "h").agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"), F.max("n_near").alias("n_near"))
    merged = broadcast_if_small(settle(merged, "hit-documents"))
    docs = _keyed(documents, id_col, text).select("id", "h", F.size("words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<struct<item_id:string>>"))
    return docs.join(merged, _same(docs, merged), "left").select(
        docs["id"].alias(id_col), docs["h"].alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.transform(items, lambda i: i["item_id"]), ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` that aren't contaminated, with their columns."""
    hits = settle(phrase_matches(documents, benchmark, id_col, text, item_col, item_text, window), "phrase-matches")
    merged = hit_words(hits)
    sizes = _keyed(documents, id_col, text).select("id", "h", F.size("words").alias("n_words"))
    near = broadcast_if_small(settle(merged.select("id", "h", "n_hit"), "hit-documents"), 64)
    bad = sizes.join(near, _same(sizes, near)).where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    bad_id, bad_h = (fresh(c, documents.columns) for c in ("bad_id", "bad_h"))
    bad = settle(bad.select(sizes["id"].alias(bad_id), sizes["h"].alias(bad_h)).distinct(), "contaminated")
    bad = broadcast_if_small(bad)
    own = F.xxhash64(F.coalesce(documents[text].cast("string"), F.lit("")))
    return documents.join(bad, documents[id_col].eqNullSafe(bad[bad_id]) & (own == bad[bad_h]), "left_anti")
