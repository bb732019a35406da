"""Which of very many terms a text contains: an index of grams and an equi-join, in place of every text against every term.

A term is found by one gram of it: of its parts of ``GRAM`` characters the one that
fewest terms have, or the whole term if it is shorter. Texts emit each gram once,
grams that lead a term are joined, and what meets is verified on the text. The
work grows with the texts and with the terms that share a gram with them.

Up to ``HELD`` terms are held by every task: grams are then looked up by numpy
where the texts lie, and what they lead to is verified in the text's own row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.llm._arrow import blocks, flat_text, mix64
from tarnweave.session import broadcast_if_small, settle

#: Characters of a gram.
GRAM = 5
#: Terms that a task holds.
HELD = 20_000
#: Bits of the table that tells which grams can't lead to a term.
TABLE_BITS = 20


def _grams(c: Column, size: Column | int) -> Column:
    """All parts of ``size`` characters, each once."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), F.lit(size).cast("string") if isinstance(size, int) else size.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(c, pattern, F.lit(1)))


def term_index(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, gram, size): each different term, lower-cased, with the gram that it is found by; empty ones are left out."""
    own = terms.select(F.lower(F.col(term)).alias("term")).where("term <> ''").distinct().withColumn("size", F.least(F.lit(GRAM), F.length("term")))
    spots = settle(own.select("term", "size", F.explode(_grams(F.col("term"), F.col("size"))).alias("gram")), "term-grams")
    shared = spots.groupBy("gram", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("term").orderBy("n", "gram")
    return spots.join(shared, ["gram", "size"]).withColumn("k", F.row_number().over(order)).where("k = 1").select("term", "gram", "size")


def _codes(flat: np.ndarray, size: int) -> np.ndarray:
    """Each ``size`` bytes in a row as one number."""
    n = max(0, len(flat) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | flat[k : k + n]
    return out


def _terms_found(terms: list[str]) -> Callable[[Column], Column]:
    """A function from texts to the places of those terms that occur in them."""
    at_gram: dict[tuple[int, int], list[int]] = {}
    n_of: dict[tuple[int, int], int] = {}
    coded = [t.encode() for t in terms]
    own = [(min(GRAM, len(t)), np.unique(_codes(np.frombuffer(t, np.uint8), min(GRAM, len(t)))).tolist()) for t in coded]
    for size, codes in own:
        for c in codes:
            n_of[size, c] = n_of.get((size, c), 0) + 1
    for place, (size, codes) in enumerate(own):
        at_gram.setdefault((size, min(codes, key=lambda c: (n_of[size, c], c))), []).append(place)
    led = {size: {c: v for (s, c), v in at_gram.items() if s == size} for size in sorted({s for s, _ in at_gram})}

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        slot = lambda codes: (mix64(codes) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        sorted_codes = {size: np.array(sorted(of), np.uint64) for size, of in led.items()}
        tables = {size: np.zeros(1 << TABLE_BITS, bool) for size in led}
        for size, codes in sorted_codes.items():
            tables[size][slot(codes)] = True
        flat, bounds = flat_text(column)
        counts, places = [], []
        for lo, hi in blocks(bounds):
            part, edge = flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            met = []
            for size, codes in sorted_codes.items():
                all_codes = _codes(part, size)
                at = np.flatnonzero(tables[size][slot(all_codes)])
                which = np.minimum(np.searchsorted(codes, all_codes[at]), len(codes) - 1)
                row = np.searchsorted(edge, at, "right") - 1
                good = (codes[which] == all_codes[at]) & (at + size <= edge[row + 1])
                met.append((size, np.unique(row[good] * len(codes) + which[good]), len(codes)))
            of_row: list[list[int]] = [[] for _ in range(hi - lo)]
            for size, pairs, n in met:
                known = [led[size][c] for c in sorted_codes[size].tolist()]
                for p in pairs.tolist():
                    of_row[p // n].extend(known[p % n])
            for r, candidates in enumerate(of_row):
                body = part[edge[r] : edge[r + 1]].tobytes()
                kept = [c for c in candidates if len(coded[c]) <= GRAM or coded[c] in body]
                counts.append(len(kept))
                places.append(np.array(kept, np.int32))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places) if places else np.zeros(0, np.int32)))

    return found


def matches(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", body: str = "text", term: str = "term", held: int = HELD) -> DataFrame:
    """(id, term): every different term that a text of the id contains, whatever the case. Null texts contain none."""
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.col(body)).alias("low")).where("low <> ''")
    few = [r["term"] for r in terms.select(F.lower(F.col(term)).alias("term")).where("term <> ''").distinct().limit(held + 1).collect()]
    if few and len(few) <= held:
        hits = rows.select("id", F.explode(_terms_found(few)(F.col("low"))).alias("place"))
        # a row has a term once, so only ids of several rows need be made distinct
        several = settle(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
        if not several.isEmpty():
            again = broadcast_if_small(several)
            mine = hits.join(again, hits["id"].eqNullSafe(again["id"]), "left_semi").distinct()
            hits = hits.join(again, hits["id"].eqNullSafe(again["id"]), "left_anti").union(mine)
        names = texts.sparkSession.createDataFrame(list(enumerate(few)), "place int, term string")
        return hits.join(F.broadcast(names), "place").select(F.col("id").alias(id_col), "term")
    index = settle(term_index(terms, term), "term-index")
    sizes = [r["size"] for r in index.select("size").distinct().collect()]  # at most as many as a gram has characters
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("term")).limit(0)
    # a gram's size is its length
    leads = rows.select("id", F.explode(F.concat(*(_grams(F.col("low"), n) for n in sorted(sizes)))).alias("gram"))
    met = settle(leads.join(broadcast_if_small(index, 64), "gram").select("id", "term").distinct(), "term-candidates")
    both = rows.join(broadcast_if_small(met, 64), rows["id"].eqNullSafe(met["id"])).select(rows["id"], "low", "term")
    return both.where(F.contains("low", F.col("term"))).select(F.col("id").alias(id_col), "term").distinct()


def entries_met(texts: DataFrame, entries: DataFrame, name: str, body: str) -> DataFrame:
    """``texts`` with an array column ``name`` of the entries (place, ..., triggers) one of whose triggers the text contains, in order of place."""
    key = F.xxhash64(*sorted(texts.columns))
    rows = settle(texts.withColumn("_row", key), "asked")
    triggers = settle(entries.select("place", F.explode("triggers").alias("trigger")).select("place", F.lower("trigger").alias("term")), "triggers")
    hits = matches(rows, triggers, "_row", body).join(triggers, "term").select("_row", "place").distinct()
    listed = hits.join(entries, "place").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", *(c for c in entries.columns if c != "place")))).alias(name))
    empty = F.array().cast(listed.schema[name].dataType)
    return rows.join(listed, "_row", "left").withColumn(name, F.coalesce(name, empty)).drop("_row")


__all__ = ["GRAM", "entries_met", "matches", "term_index"]
