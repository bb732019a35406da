"""Spelling variants, language identification and the filter audit against brute force: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import filteraudit, langid, variants

DOCS = "doc_id long, text string, lang string, id string, key int, n int, word string, held_out string, score string"


def table(spark, rows):
    """Documents (doc_id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "w", "no", "0") for r in rows], DOCS)


# --- op11 -------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    close = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_variants(spark):
    rng = random.Random(5)
    bases = ["kathedrale", "straßenbahn", "élèvement", "parallel", "aaaaaaaa", "abcabcabc", "cabcabcab", "x×÷yzuvw", "ßÿàéîõü"]
    long_word = "".join(rng.choice("abcdeé") for _ in range(3_000))
    docs = [(None, "Kathedrale katHedrale"), (1, None), (2, ""), (3, "short"), (4, long_word + " " + long_word), (5, f"{long_word[:1500]}z{long_word[1500:]} " * 2)]
    for i in range(6, 120):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(bases[: rng.randrange(1, len(bases) + 1)])
            if rng.random() < 0.15:
                at, c = rng.randrange(len(w)), rng.choice("aeéz")
                w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + w[at:][::-1], w.upper(), w.capitalize()])
            words.append(w)
        docs.append((i, rng.choice([" ", ", ", "1", "_"]).join(words)))
    docs += [docs[9], docs[9]] + [(200 + i, "wurzelnn " * 200 + "wurzelna " * 14 + "wurzelxa") for i in range(3)]
    got, want = variant_rows(variants.group_variants(table(spark, [(*d, "en") for d in docs]))), plain_variants(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1]) and max(r[4] for r in want) > 5
    assert variants.group_variants(table(spark, [(1, None, None)])).count() == 0
    assert variants.group_variants(table(spark, docs and [(1, "a", "b")]).limit(0)).count() == 0


def test_variants_broadcast_nothing(spark):
    """Whatever size Spark takes the exploded words for, no join gathers them in the driver: a broadcast of 1 KB would fail here."""
    docs = [(i, f"kathedrale{'abcdefgh'[i % 8]} kathedrale strassenbahn" + "en" * (i % 3)) for i in range(300)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")
    try:
        got = variant_rows(variants.group_variants(table(spark, [(*d, "en") for d in docs])))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs) and any(r[1] for r in got)


def test_anagram_keys_tell_exchanges_apart():
    powers = [c**variants.POWER for c in [*range(97, 123), *range(0xC0, 0x100)]]
    assert len({a - b for a, b in permutations(powers, 2)}) == len(powers) * (len(powers) - 1)


# --- op12 -------------------------------------------------------------------

SYLLABLES = {"one": ["tha", "ing", "er", "wh"], "two": ["eau", "ion", "que", "ér"], "three": ["sch", "ung", "über", "keit"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def spoken(rng, n):
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(1, 80)), lang) for i in range(n)]
    return [*rows, (n, None, "one"), (n + 1, "", "two"), (n + 2, " 12 -- !", "two"), (n + 3, speech(rng, "two", 5), None), (None, speech(rng, "three", 30), "three"), (n + 4, "ЖЖЖ", None), (n + 5, speech(rng, "one", 200_000), "one"), rows[0], rows[0]]


def test_languages_are_told_apart(spark):
    rows = spoken(random.Random(3), 300)
    got = langid.identify(table(spark, rows))
    assert got.columns == [*(c for c in DOCS.replace(",", "").split()[::2] if c != "text"), "lang_pred", "_score", "_held_out"]
    found = got.collect()
    assert len(found) == len(rows)
    truth = {r[0]: r for r in rows}
    for r in found:
        _, text, lang = truth[r["doc_id"]]
        assert r["_held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["_score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["lang_pred"] == "und":
            assert r["_score"] == 0
    held = [r for r in found if r["_held_out"] and r["lang_pred"] != "und" and truth[r["doc_id"]][2]]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]][2] for r in held) >= 0.98 * len(held)
    assert next(r["lang_pred"] for r in found if r["doc_id"] == 303) == "two"


def test_decisions_are_those_of_plain_kernels(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 700)
    rng = random.Random(4)
    sample = langid.settle(langid.training_sample(table(spark, spoken(rng, 90))), "sample")
    model = langid.fit(sample, landmarks=24)
    rows = sample.collect()
    grams = lambda t: {s[i : i + k] for s in [re.sub("[^a-zà-ÿ]+", " ", t.lower()).lstrip()] for k in (1, 2, 3) for i in range(len(s) - k + 1)} - {" "}
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    marks = [grams(r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])) if r["rank"] <= 24 // len(model.languages)]
    near_ = np.array([[kernel(grams(r["text"]), m) for m in marks] for r in rows])
    goal = np.array([[1.0 if r["lang"] == x else -1.0 for x in model.languages] for r in rows])
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    weights = np.linalg.lstsq(near_.T @ near_ + langid.RIDGE * len(rows) * between + 1e-9 * len(rows) * np.eye(len(marks)), near_.T @ goal, rcond=None)[0]
    texts = [speech(rng, lang, n) for lang in SYLLABLES for n in (1, 3, 40, 900)]
    values = np.array([[kernel(grams(t), m) for m in marks] for t in texts]) @ weights
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model).orderBy("i").collect()
    assert [r["lang_pred"] for r in got] == [model.languages[k] for k in values.argmax(1)]
    assert np.allclose([r["score"] for r in got], np.clip((1 + values.max(1)) / 2, 0, 1), atol=2e-3)


def test_nothing_to_learn_from(spark):
    rows = [(1, "some words", None), (None, None, None)]
    assert {(r["lang_pred"], r["_score"]) for r in langid.identify(table(spark, rows)).collect()} == {("und", 0.0)}
    assert langid.identify(table(spark, rows).limit(0)).count() == 0


# --- op13 -------------------------------------------------------------------


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    masks = []
    for i, t, part in docs:
        t, w = t or "", words(t or "")
        failed = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > ids[t],
        }
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        masks.append((part or "", {f for f, x in failed.items() if x}, good, toxic))
    out = set()
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        removed_by = {f: sum(bool(f in m[1]) and next(x for x in order if x in m[1]) == f for order in permutations("ABCDE") for m in mine) for f in "ABCDE"}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                gone = sum(f in m[1] for m in mine) - len(lost)
                out.add((part, "".join(order), step, len(left), len(lost), gone, sum(m[1] == {f} for m in mine), sum(m[2] for m in lost), sum(m[3] for m in lost), removed_by[f]))
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_filter_audit(spark, monkeypatch, collide):
    if collide:  # all texts of a class of hashes: only whole texts tell them apart
        monkeypatch.setattr(filteraudit, "_class", lambda n, h, level=None: F.pmod(n, F.lit(2)).cast("long"))
    rng = random.Random(6)
    tail = "".join(rng.choice("ab ") for _ in range(30_000))
    texts = [None, "", "ONE TWO", "a b # c", " ".join(f"w{i}" for i in range(120)), "same " * 200, "  no break\x0b", tail + "x", tail + "y", tail[:300] + "q", tail[:300] + "r", "É" * 9 + "A"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "fr", "", None])) for _ in range(90)]
    docs += [(50, "ONE TWO", "de"), (50, "ONE TWO", "de"), (51, "twice", "de"), (51, "twice", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, 1, 1, 2, *range(5, 40), 50]]
    known = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, id string")
    got = [tuple(r) for r in filteraudit.audit(table(spark, docs), known).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs, labels)
    assert filteraudit.audit(table(spark, docs).limit(0), known).count() == 0
    assert filteraudit.audit(table(spark, docs), known.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0
