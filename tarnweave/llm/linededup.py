"""Line dedup by a deletion-neighbourhood join.

Only DataFrame functions are used. Lines are compared as lists of words (lower
case, split at white space). A line goes if an earlier line has the same words or
is a near copy: within one word edit (a word put in, left out or changed), where
the longer of the two has ``NEAR_WORDS`` (10) words or more, so they agree in nine
tenths. Earlier is the smaller (document id, line number). Lines without words stay.

The neighbourhood of a line is the line itself and each line that leaves one word
out; two lines within one edit have a variant in common. Variants are keyed by
hashes, equal keys are joined, and the edit is verified on the words themselves:

1. As nearly all lines have no near copy, coarse neighbourhoods find those that
   may. They leave out not a word but a stretch of words at a time; one edit lies
   within one stretch, so lines within one edit still share a key. First a half of
   the line is left out, then, of the lines that share such a key, an eighth; those
   that share a key again are the suspects.
2. Suspects get their full neighbourhood. Its
   keys also hold the place of the word left out, so a group of equal keys is
   within one edit pairwise and its earliest line answers for all: a group never
   yields pairs.

Defined cases: null and empty texts have no lines to lose; rows that repeat id and
text are one document; a null id is later than all others; an empty table gives
an empty result; other columns are ignored by ``line_decisions`` and kept by
``dedup_lines``, whatever their names. Long lines have a linear number of variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm._names import fresh
from tarnweave.session import broadcast_if_small, settle

#: Words that the longer of two near copies has at least.
NEAR_WORDS = 10
#: Words up to which a line's variants are made inside its row.
ROW_WORDS = 48
#: Parts of a line, one of which is left out as a whole, in the second step; the first one leaves out halves.
STRETCHES = 8


def words_of(line: Column) -> Column:
    """The lower-case words; the single blank, by which Spark splits fastest, suffices for lines without other white space."""
    low, other = F.lower(line), line.contains("\t") | line.contains("\r") | line.contains("\f") | line.contains("\x0B")
    return F.array_remove(F.when(other, F.split(low, r"\s+")).otherwise(F.split(low, " ")), "")


def lines_of(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, line_no, line): h tells texts of one id apart."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _left_out(items: Column, length: Column, n: Column, j: Column, parts: int) -> Column:
    """The key of a line without the ``j``-th of ``parts`` stretches, where the shorter of two lines (or both) has ``n`` words."""
    start, stop = F.floor(j * n / parts).cast("int"), F.floor((j + 1) * n / parts).cast("int")
    return F.xxhash64(n, j, F.slice(items, 1, start), F.slice(items, length - (n - stop) + 1, n - stop))


def half_keys(words: Column, n: Column) -> Column:
    """Keys of a line with each half left out, as the shorter and as the longer of two lines; without lambdas, as all lines get them."""
    return F.array(*(_left_out(words, n, shorter, F.lit(j), 2) for shorter in (n, n - 1) for j in (0, 1)))


def _order() -> Column:
    """Where a line stands among all lines."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"), F.col("line_no").alias("line_no"))


def line_table(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, line_no, n, lh, keys): n words, their hash, and the keys of both halves."""
    rows = lines_of(documents, id_col, text).select("id", "h", "line_no", words_of(F.col("line")).alias("words"))
    rows = rows.select("id", "h", "line_no", "words", F.size("words").alias("n"), F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit("line"), "words").alias("b")).alias("lh"))
    keys = F.when(F.col("n") >= NEAR_WORDS - 1, half_keys(F.col("words"), F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("id", "h", "line_no", "n", "lh", keys.alias("keys"))


def suspects(lines: DataFrame) -> DataFrame:
    """(lh): lines that share a half's key with a line of other words."""
    keyed = lines.select(F.explode("keys").alias("key"), F.col("lh.a").alias("a"))
    shared = keyed.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("key")
    shared = broadcast_if_small(settle(shared, "shared-keys"), 32, 1_000_000)
    return lines.select("lh", F.explode("keys").alias("key")).join(shared, "key", "left_semi").select("lh").distinct()


def _suspect_lines(documents: DataFrame, lines: DataFrame, firsts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(sid, lh, words): the first occurrence of each suspect, once even if its row is repeated; sid grows with its order."""
    found = suspects(lines).join(firsts, "lh").select("lh", "first.id", "first.h", "first.line_no")
    found = broadcast_if_small(settle(found, "suspects"), 64, 500_000)
    # only the texts that hold a suspect are split again
    holders = broadcast_if_small(found.select(F.col("id").alias("_holder"), F.col("h").alias("_text")).distinct(), 64, 500_000)
    slim = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    slim = slim.join(holders, slim["id"].eqNullSafe(holders["_holder"]) & (F.xxhash64(slim["text"]) == holders["_text"]), "left_semi")
    rows = lines_of(slim, "id", "text")
    same = rows["id"].eqNullSafe(found["id"]) & (rows["h"] == found["h"]) & (rows["line_no"] == found["line_no"])
    rows = rows.join(found, same).select("lh", rows["id"], rows["h"], rows["line_no"], words_of(F.col("line")).alias("words"))
    rows = rows.dropDuplicates(["lh"])  # rows that repeat id and text are one document, or a line would be near its own copy
    rows = rows.orderBy(_order(), "lh").select(F.monotonically_increasing_id().alias("sid"), "lh", "words")
    return settle(rows, "suspect-lines")


def stretch_keys(hashes: Column) -> Column:
    """Keys of a line with each of ``STRETCHES`` stretches left out, as the shorter and as the longer of two lines."""
    length = F.size(hashes)
    of = lambda n: F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda j: _left_out(hashes, length, n, j, STRETCHES))
    return F.concat(of(length), of(length - 1))


def still_suspect(suspect_lines: DataFrame) -> DataFrame:
    """Those of the suspects that share a stretch key with one of them."""
    hashed = suspect_lines.select("sid", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    keyed = settle(hashed.select("sid", F.explode(let(F.col("hashes"), stretch_keys)).alias("key")), "stretch-keys")
    shared = keyed.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
    left = keyed.join(broadcast_if_small(settle(shared, "shared-stretches"), 32, 500_000), "key", "left_semi").select("sid").distinct()
    return settle(suspect_lines.join(broadcast_if_small(settle(left, "left-suspects"), 32, 500_000), "sid", "left_semi"), "suspects-left")


def variants(lines: DataFrame) -> DataFrame:
    """(sid, place, key): a line's variants with the word at ``place`` left out.

    A list of words is hashed as the exclusive or of its words' hashes, each
    salted with the word's place, so all variants follow from running values.
    """
    n = F.size("words")
    before = lambda w, i: F.xxhash64(w, i)
    after = lambda w, i: F.xxhash64(w, i - 1)
    running = lambda seq: F.aggregate(seq, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))
    short = lines.where(n <= ROW_WORDS).select("sid", n.alias("n"), running(F.transform("words", before)).alias("p"), running(F.transform("words", after)).alias("s"))
    left_out = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(F.get("p", i).bitwiseXOR(F.get("s", F.col("n"))).bitwiseXOR(F.get("s", i + 1)), F.col("n") - 1))
    short = short.select("sid", F.posexplode(left_out).alias("place", "key"))
    up_to = Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    long = lines.where(n > ROW_WORDS).select("sid", n.alias("n"), F.posexplode("words").alias("place", "word"))
    long = long.select("sid", "n", "place", before(F.col("word"), F.col("place")).alias("a"), after(F.col("word"), F.col("place")).alias("b"))
    p, s, total = F.bit_xor("a").over(up_to).bitwiseXOR(F.col("a")), F.bit_xor("b").over(up_to), F.bit_xor("b").over(Window.partitionBy("sid"))
    return short.union(long.select("sid", "place", F.xxhash64(p.bitwiseXOR(total).bitwiseXOR(s), F.col("n") - 1).alias("key")))


def full_keys(lines: DataFrame) -> DataFrame:
    """(sid, key): the key of the whole line, as a longer line's variant would have it."""
    total = F.aggregate(F.transform("words", lambda w, i: F.xxhash64(w, i)), F.lit(0).cast("bigint"), lambda t, x: t.bitwiseXOR(x))
    return lines.select("sid", F.xxhash64(total, F.size("words")).alias("key"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two lists of words differ by at most one word put in, left out or changed."""
    longest = F.greatest(F.size(a), F.size(b))

    def agreeing(x: Column, y: Column) -> Column:
        first_odd = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), F.lit(False))
        return F.when(first_odd == 0, longest).otherwise(first_odd - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (agreeing(a, b) + agreeing(F.reverse(a), F.reverse(b)) >= longest - 1)


def near_lines(suspect_lines: DataFrame) -> DataFrame:
    """(lh): suspects with an earlier line within one edit."""
    suspect_lines = still_suspect(suspect_lines)
    left_out = settle(variants(suspect_lines.where(F.size("words") >= NEAR_WORDS)), "variants")
    whole = settle(full_keys(suspect_lines), "whole-lines")
    groups = left_out.groupBy("key", "place").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first < last").select("key", "place", "first")
    groups = broadcast_if_small(settle(groups, "variant-groups"), 48, 500_000)
    changed = left_out.join(groups, ["key", "place"]).where("first < sid").select("sid", "first")
    whole = broadcast_if_small(whole.select("key", F.col("sid").alias("other")), 32, 500_000)
    longer = left_out.join(whole, "key").where("sid <> other").select(F.greatest("sid", "other").alias("sid"), F.least("sid", "other").alias("first"))
    # a line may have several earlier neighbours; one that is verified is enough
    pairs = changed.union(longer).groupBy("sid").agg(F.min("first").alias("first"))
    words = suspect_lines.select("sid", "words")
    earlier = words.select(F.col("sid").alias("first"), F.col("words").alias("earlier"))
    verified = pairs.join(suspect_lines.select("sid", "lh", "words"), "sid").join(earlier, "first").where(within_one_edit(F.col("words"), F.col("earlier")))
    return verified.select("lh")


def line_decisions(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, line_no, reason): lines that go, as ``exact`` or ``near`` copies of earlier ones."""
    lines = settle(line_table(documents, id_col, text), "lines")
    firsts = lines.where("n > 0").groupBy("lh").agg(F.min(_order()).alias("first"), F.count("*").alias("n_lines"))
    firsts = settle(firsts, "first-lines")
    near = settle(near_lines(_suspect_lines(documents, lines, firsts, id_col, text)), "near-lines")
    marked = firsts.join(broadcast_if_small(near.withColumn("near", F.lit(True)), 32, 500_000), "lh", "left").where("near or n_lines > 1").select("lh", "first", "near")
    marked = broadcast_if_small(settle(marked, "marked-lines"), 80, 400_000)
    found = lines.where("n > 0").select("id", "h", "line_no", "lh").join(marked, "lh")
    reason = F.when(~F.col("first").eqNullSafe(_order()), "exact").when(F.col("near"), "near")
    return found.select("id", "h", "line_no", reason.alias("reason")).where(F.col("reason").isNotNull())


def document_decisions(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, n_exact, n_near, removed): of documents that lose lines, the line numbers (from 0)."""
    gone = line_decisions(documents, id_col, text).distinct()  # rows that repeat id and text count once
    return gone.groupBy("id", "h").agg(F.count_if(F.col("reason") == "exact").alias("n_exact"), F.count_if(F.col("reason") == "near").alias("n_near"), F.array_sort(F.collect_list("line_no")).alias("removed"))


def _joined(documents: DataFrame, decisions: DataFrame, id_col: str, text: str) -> DataFrame:
    """``documents`` with the columns of their decisions, whose names must be free."""
    own = F.xxhash64(F.coalesce(documents[text].cast("string"), F.lit("")))
    return documents.join(decisions, documents[id_col].eqNullSafe(decisions[decisions.columns[0]]) & (own == decisions[decisions.columns[1]]), "left")


def _decided(documents: DataFrame, id_col: str, text: str) -> tuple[DataFrame, dict[str, str]]:
    """The decisions under names that ``documents`` doesn't have, and these names."""
    decisions = settle(document_decisions(documents, id_col, text), "line-decisions")
    names = {c: fresh(c, documents.columns) for c in decisions.columns}
    return broadcast_if_small(decisions.select(*(F.col(c).alias(n) for c, n in names.items()))), names


def summarise(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_lines, n_exact, n_near, removed_lines) of every row."""
    slim = documents.select(F.col(id_col), F.col(text))
    decisions, name = _decided(slim, id_col, text)
    n_lines = F.size(F.split(F.coalesce(slim[text].cast("string"), F.lit("")), "\n")).cast("long")
    zero = lambda c: F.coalesce(decisions[name[c]], F.lit(0)).cast("long").alias(c)
    return _joined(slim, decisions, id_col, text).select(slim[id_col], n_lines.alias("n_lines"), zero("n_exact"), zero("n_near"), F.coalesce(decisions[name["removed"]], F.array().cast("array<int>")).alias("removed_lines"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text: str = "text", drop_emptied: bool = True) -> DataFrame:
    """``documents`` without the lines that go; ``drop_emptied``: without texts that lost all their lines with words."""
    decisions, name = _decided(documents, id_col, text)
    removed = decisions[name["removed"]]

    def kept(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed), lambda i: F.get(parts, i)), "\n")

    left = F.when(removed.isNull(), documents[text]).otherwise(let(F.split(documents[text].cast("string"), "\n"), kept))
    rows = _joined(documents, decisions, id_col, text)
    rows = rows.select(*(left.alias(c) if c == text else documents[c] for c in documents.columns), removed.isNull().alias(fresh("whole", documents.columns)))
    if drop_emptied:
        rows = rows.where(F.col(rows.columns[-1]) | F.col(text).rlike(r"\S"))
    return rows.select(*documents.columns)
