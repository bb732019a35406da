"""Spelling variants: words within one inserted, deleted or replaced letter, by anagram keys.

A word's anagram key is the sum of the fifth powers of its letters' code points,
so words of the same letters in any order share it, and one letter more, less
or another changes it by a known value. A word emits its key less each letter
that may differ, and its key as it is: two words that differ by a replacement meet
where their keys less one letter each are equal, and a word meets a shorter one at
the key that the shorter has as a whole. As one difference lies on one side of a
cut only, a hash of the other side is part of what is joined; it drops the
anagrams of concatenated parts and loses no pair. What meets is verified by edit
distance, so that nothing depends on hashes.

A word emits at most a row for each different letter and side, however long it
is, so groups need no cap; rows carry hashes of words and not the words. Every
join is a shuffle join (``shuffled``), as all sides are as large as the vocabulary.

Cases: null and empty texts have no words. A null id counts as the empty text.
Rows that are repeated count as often as they are there. Other columns are left
alone. Runs of any length are words; a run without another like it has n = 1
and isn't returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.session import drop_settled, settle

# The letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times more frequent a word's form is.
RATIO = 10
#: One of so many runs loses a letter.
DAMAGE = 31
#: The power of anagram keys, and the modulus that keeps their sums within a long.
POWER, MODULUS = 5, 2**61 - 1
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark sizes a table by its compressed files and the widths of its columns, and an explode by
    columns alone: it takes ten million rows of exploded words for 7 MB and would gather them in the driver.
    """
    return df.hint("merge")


def damaged(doc_id: Column, run: Column) -> Column:
    """The run without one letter where the checksum of document and run is divisible by ``DAMAGE``."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs; shorter and rarer ones are left out."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    low = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")))
    words = low.select(damaged(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _power(point: Column) -> Column:
    return F.pow(point.cast("double"), F.lit(POWER)).cast("long")


def _letters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def anagram_key(c: Column) -> Column:
    return F.aggregate(_letters(c), F.lit(0).cast("long"), lambda acc, x: (acc + _power(F.ascii(x))) % MODULUS)


def _middle(n: Column) -> Column:
    """Where a word is cut: the middle of the word that is one letter shorter."""
    return F.floor((n - 1) / 2).cast("int")


def candidate_pairs(words: DataFrame) -> DataFrame:
    """(a, b, side): hashes of words that may be near. ``words``: (word, id, key).

    A pair meets in side 0 if the letter in question lies behind the cut, and may
    meet in side 1 if it lies before it. ``a`` is the longer word.
    """
    n = F.length("word")
    head, tail = (lambda size: F.substring("word", F.lit(1), size)), (lambda start: F.substring("word", start + 1, n))
    cut = lambda kept, changed, side: F.struct(F.xxhash64(kept).alias("half"), changed.alias("changed"), F.lit(side).alias("side"))
    middle, whole = _middle(n), _middle(n + 1)
    # a word less one letter, of the part that isn't kept; words of one length meet here
    less = words.select("id", "key", n.alias("size"), F.explode(F.array(cut(head(middle), tail(middle), 0), cut(tail(middle + 1), head(middle), 1))).alias("x"))
    less = less.select("id", "key", "size", "x.half", "x.side", F.explode(F.transform(F.array_distinct(_letters(F.col("x.changed"))), F.ascii)).alias("gone"))
    less = less.withColumn("key", F.pmod(F.col("key") - _power(F.col("gone")), F.lit(MODULUS)))
    # a word as it is, which words that are one letter longer meet
    asis = words.select("id", "key", (n + 1).alias("size"), F.explode(F.array(cut(head(whole), F.lit(""), 0), cut(tail(whole), F.lit(""), 1))).alias("x"))
    asis = asis.select("id", "key", "size", "x.half", "x.side", F.lit(0).alias("gone"))
    rows = less.union(asis).select(F.xxhash64("key", "half", "size", "side").alias("meet"), "id", "side", F.col("gone").cast("short").alias("gone"))
    other = rows.select("meet", F.col("id").alias("b"), F.col("gone").alias("gone_b"))
    longer = F.col("gone_b") == 0
    swapped = (F.col("gone_b") != F.col("gone")) & (F.col("id") <= F.col("b"))
    return rows.join(shuffled(other), "meet").where((F.col("gone") != 0) & (longer | swapped)).select(F.col("id").alias("a"), "b", "side")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): both directions of every link, once each. ``words``: (word, n, id, key), settled."""
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = candidate_pairs(words).join(shuffled(side("a")), "a").join(shuffled(side("b")), "b")
    cut = _middle(F.greatest(F.length("word_a"), F.length("word_b")))
    # of words that agree before the cut, the pair of side 0 counts
    once = (F.col("side") == 0) | (F.substring("word_a", F.lit(1), cut) != F.substring("word_b", F.lit(1), cut))
    links = pairs.where((F.levenshtein("word_a", "word_b", 1) == 1) & once)
    both = F.array(*(F.struct(F.col(f"word_{x}").alias("word"), F.col(f"word_{y}").alias("other"), F.col(f"n_{y}").alias("other_n")) for x, y in ("ab", "ba")))
    return links.select(F.explode(both).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where each chain of forms ends.

    Counts grow tenfold along a chain, so chains are short, and each round doubles the steps that are taken.
    """
    reach = settle(forms.select("word", F.col("form").alias("root")), "reach")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        met = settle(reach.join(shuffled(onward), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "reach")
        drop_settled(reach)
        reach = met.select("word", "root")
        if not met.where("moved").limit(1).count():
            return reach


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``LEAST_COUNT`` occurrences.

    A form is the most frequent near word (of several the smallest) if it is
    ``RATIO`` times as frequent as the word itself; the root is where forms end.
    """
    words = settle(word_counts(docs, id_col, text_col).withColumns({"id": F.xxhash64("word"), "key": anagram_key(F.col("word"))}), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.select("word", "n").join(shuffled(near), "word", "left")
    takes = -F.col("best.less") >= RATIO * F.col("n")
    rows = settle(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(shuffled(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
