"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import annsearch, bpe, chatformat, decontaminate, licenses, linededup, quality, simhash, suffixdedup, warc
from tarnweave.llm.queries import vocabulary

DOCS = "doc_id long, text string, id string, h int, words string"


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, f"c{k}", k, "w") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def prose(rng, n, words=40):
    return " ".join(f"{rng.choice('aeiou')}{rng.choice('bcdfg')}{rng.randrange(words)}" for _ in range(n))


# --- op1 --------------------------------------------------------------------


def archived(spark, rows, path, kind="long"):
    """The records of the WARC files that are written of the rows, and the archive's name."""
    name = warc.write_archive(spark.createDataFrame(rows, f"page_id {kind}, url string, html string, digest string, seq int, first int"), path)
    warc.write_warc(spark, path, path + "/warc", 3)
    return sorted(((r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.records(spark, path + "/warc", name).collect()), key=str), name


@pytest.mark.parametrize("few", [0, 100])
def test_warc_round_trip(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_REPEATED", few)
    big, cut = "<p>é</p>" * 40, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny" * 3
    rows = [(5, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "short"), (4, "u", "short"), (9, "v", None), (None, "w", big), (2, "http://b/", big), (11, "é", cut), (12, "z", "long " * 100_000)]
    path = str(tmp_path / "a")
    got, name = archived(spark, [(*r, "d", 1, 2) for r in rows], path)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    n = len(big.encode())
    want = [("2", "response", n, digest(big), None), ("2", "revisit", n, digest(big), "2"), ("5", "revisit", n, digest(big), "2"), (None, "revisit", n, digest(big), "2")]
    want += [(str(i), "response", len((t or "").encode()), digest(t), None) for i, _, t in rows if t != big]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    # the files hold the exact headers, and a record's block is its payload
    read = warc.read_warc(spark, path + "/warc", name).collect()
    assert Counter(r["header"] for r in read) == Counter(bytes(r["header"]).decode() for r in spark.read.parquet(f"{path}/headers").collect())
    assert Counter(bytes(r["block"]) for r in read) == Counter([big.encode(), b"short", b"short", b"", b"", b"", b"", cut.encode(), b"long " * 100_000])
    plain = b"".join(__import__("gzip").open(f).read() for f in sorted((tmp_path / "a/warc").glob("part-*")))
    assert sorted(bytes(r["record"]) for r in warc.reconstruct(spark, path).collect()) == sorted((r["header"].encode() + bytes(r["block"])) for r in read)
    assert len(plain) == sum(len(r["header"].encode()) + len(r["block"]) + 4 for r in read)


def test_warc_of_other_writers(spark, tmp_path):
    def record(block):
        return b"WARC/1.1\r\nWARC-Type: response\r\ncontent-length:%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record(b"one\r\n\r\ntwo") + record(b"") + record(b"\xff\x00"))
    assert [bytes(r["block"]) for r in warc.read_warc(spark, str(tmp_path / "a.warc")).collect()] == [b"one\r\n\r\ntwo", b"", b"\xff\x00"]
    (tmp_path / "b.warc").write_bytes(record(b"x\r\n\r\n" + record(b"y")))
    with pytest.raises(Exception, match="cut record"):
        warc.read_warc(spark, str(tmp_path / "b.warc")).collect()


def test_warc_ids_damage_and_empty(spark, tmp_path):
    assert archived(spark, [], str(tmp_path / "e"))[0] == []
    page = "<p>page</p>" * 20
    rows = [("p:2 é", "u", page, "d", 1, 2), ("p1", "u", page, "d", 1, 2), ("", "u", page, "d", 1, 2)]
    got, _ = archived(spark, rows, str(tmp_path / "s"), "string")
    assert [(r[0], r[1], r[4]) for r in got] == [("", "response", None), ("p1", "revisit", ""), ("p:2 é", "revisit", "")]
    path = str(tmp_path / "d")
    archived(spark, [(1, "u", "x", "d", 1, 2)], path)
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), b"y")], "payload_digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.reconstruct(spark, path).collect()


# --- op2 --------------------------------------------------------------------


def plain_scan(text):
    units = (text or "").split("\n")
    units += (text or "").split("\n\n") if "\n\n" in (text or "") else []
    units += [text] if "\n" in (text or "") else []
    out = []
    for u in units:
        w = re.findall(r"[^\W_]+", u.lower())
        p = set(zip(w, w[1:], strict=False))
        best = None
        for name, body in sorted(licenses.TEMPLATES.items()):
            v = re.findall(r"[^\W_]+", body.lower())
            q = set(zip(v, v[1:], strict=False))
            s = 2 * len(p & q) / (len(p) + len(q)) if p else 0
            if s >= licenses.THRESHOLD and (best is None or s > best[0]):
                best = (s, name)
        out += [best] if best else []
    return out


def test_licenses(spark):
    rng = random.Random(0)
    texts = [None, "", "one", "word " * 70_000]
    for _ in range(120):
        w = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(rng.choice(["", "before\n\n", "x "]) + " ".join(w) + rng.choice(["", "\nafter", "\n\nMore."]))
    got = {r["doc_id"]: (r["license"], r["score"], r["n_units"], r["licenses"]) for r in licenses.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        found = plain_scan(t)
        best = min(((-s, n) for s, n in found), default=None)
        assert got[i] == (best and best[1], best and round(-best[0], 6), len(found), ",".join(sorted({n for _, n in found}))), i
    assert licenses.scan(table(spark, [])).count() == 0


def plain_notices(text, templates):
    """Every unit and every window of every template, one by one."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    text, out, w = text or "", {}, words(text)
    units = [words(u) for u in [*text.split("\n"), *text.split("\n\n"), text]]
    dice = lambda p, q: 2 * len(p & q) / (len(p) + len(q)) if p else 0
    wanted = {name: (len(words(t)), pairs(words(t))) for name, t in templates.items()}
    for u in units:
        s, name = min((-dice(pairs(u), q), n) for n, (_, q) in wanted.items())
        if -s >= licenses.THRESHOLD:
            out[name] = max(-s, out.get(name, 0))
    for name, (n, q) in wanted.items():
        s = max(dice(pairs(w[i : i + n]), q) for i in range(max(1, len(w) - n + 1)))
        if s >= licenses.THRESHOLD:
            out[name] = max(s, out.get(name, 0))
    return out


def test_notices_in_windows(spark, monkeypatch):
    rng = random.Random(3)
    short = licenses.TEMPLATES | {"all-rights-reserved": "All rights reserved."}
    texts = [None, "", "one", "All rights reserved."]
    for _ in range(60):
        w = rng.choice(list(short.values())).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zzz"
        w[len(w) // 2 : len(w) // 2] = [rng.choice(["", "\n", "\n"])]
        texts.append(prose(rng, rng.randrange(60)) + rng.choice([" ", "\n"]) + " ".join(w) + rng.choice([" ", "\n"]) + prose(rng, rng.randrange(60)))
    got = {r["doc_id"]: r for r in licenses.scan_notices(table(spark, texts), short).collect()}
    for i, t in enumerate(texts):
        want = plain_notices(t, short)
        assert got[i]["licenses"] == ",".join(sorted(want)) and got[i]["n_licenses"] == len(want), i
        assert got[i]["score"] == (round(max(want.values()), 6) if want else None), i
    # runs of words: the same result wherever a run ends
    known = licenses.Templates(short, licenses.THRESHOLD)
    whole = [known.windows(t or "") for t in texts]
    monkeypatch.setattr(licenses, "STEP", 7)
    assert [known.windows(t or "") for t in texts] == whole


def test_full_licence_texts(spark):
    full = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    names = sorted(full)
    texts = [prose(random.Random(5), 50) + " " + " ".join(full[n].split()) + " and more" for n in names]
    texts += ["copyright x, all\nrights reserved by y", "nothing of the kind"]
    got = [r["licenses"].split(",") for r in licenses.scan_notices(table(spark, texts)).orderBy("doc_id").collect()]
    assert all(n in found for n, found in zip(names, got, strict=False))
    assert got[-2:] == [["all-rights-reserved"], [""]]
    assert licenses.scan_notices(table(spark, [])).count() == 0


# --- op3 --------------------------------------------------------------------


def plain_rotation(turns, segment):
    """Every dialogue from every perspective, turn by turn."""
    said, out = {}, {}
    for conv, turn, role, text in turns:
        role = (role or "").strip().replace("<|im_", "<| im_") or "unknown"
        said.setdefault(conv, []).append((turn is not None, turn or 0, role, (text or "").replace("<|im_", "<| im_")))
    for conv, rows in said.items():
        rows = [(r, t) for _, _, r, t in sorted(rows)]
        system = [x for x in rows if x[0] == "system"][:1]
        for who in {r for r, _ in rows if r != "system"}:
            for s in range(0, len(rows), segment):
                body, mask = "", []
                for r, t in (system if s else []) + rows[s : s + segment]:
                    body += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == who else "user name=" + r) + "\n"
                    if r == who:
                        mask.append((len(body), len(body) + len(t) + 10))
                    body += t + "<|im_end|>\n"
                out[conv, who, s // segment] = (len(rows[s : s + segment]), len(mask), body, mask)
    return out


@pytest.mark.parametrize("segment", [3, 256, None])
def test_chat_rotation(spark, segment):
    rng = random.Random(3)
    rows = [(1, 0, "system", "rules"), (1, 1, "Ann", "hi <|im_end|>"), (1, 2, "Bob", None), (1, 3, None, "who"), (2, 0, "system", "alone"), (None, 0, "A", "x"), (1, 300, "Ann", "later"), (1, None, "Bob", "no turn"), (3, 0, "x<|im_end|>", "é" * 50_000)]
    rows += [(4, rng.choice([None, 1, 2, 3, k]), rng.choice(["system", "u", "v", "w", " "]), rng.choice(["a", "b", ""])) for k in range(257)]
    rows += rows[10:14]
    df = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "conv_id long, turn long, role string, text string, k int, place int, perspective string")
    got = {(r["conv_id"], r["perspective"], r["segment"]): (r["n_turns"], r["n_own"], r["rendered"], [(m["start"], m["stop"]) for m in r["mask"]]) for r in chatformat.rotate(df, segment_turns=segment).collect()}
    assert got == plain_rotation(rows, segment or 10**9)
    assert chatformat.rotate(df.limit(0)).count() == 0
    assert chatformat.rotate(df.withColumnRenamed("conv_id", "segment"), conv="segment").columns[:3] == ["segment", "perspective", "_segment"]


# --- op4 --------------------------------------------------------------------


def test_bpe_against_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    rng = random.Random(1)
    texts = [None, "", " ", "a", "don't  stop\n\n \t x", "naïve ß 中文字 😀👍🏽", "<|endoftext|>x<|endoftext|>", "aaaaaaaaaaaaaaaaaa", "  　 x", "x" * 5000, "é \x00\x7f\r\n"]
    texts += ["".join(chr(rng.choice([32, 10, 9, *range(33, 127), *range(160, 600), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640)])) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts.append(" ".join(prose(rng, 400) for _ in range(400)))
    got = {r["doc_id"]: r for r in bpe.round_trip(table(spark, texts), vocabulary()).collect()}
    ids = {r["doc_id"]: (r["ids"], r["n_tokens"], r["decodes"]) for r in bpe.tokenise(table(spark, texts), vocabulary()).collect()}
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == (want, len(want), True), text
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest(), text
    assert bpe.encode(table(spark, []), vocabulary()).count() == 0
    back = bpe.decode(bpe.encode(table(spark, texts[:9]), vocabulary()), vocabulary()).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


# --- op5 --------------------------------------------------------------------


def plain_contamination(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def plain_proximity(docs, items, corpus=None, slop=8):
    """(id, item, position, terms) by trying every shift of every document against every item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = Counter(w for t in (corpus or [t for _, t in docs]) for w in words(t))
    out = set()
    for item, body in items:
        v = words(body)
        terms = sorted({(counts[w], w) for w in v if counts[w]})[:4]
        if len(terms) < 2:
            continue
        terms, need = {w for _, w in terms}, min(3, len(terms))
        for i, text in docs:
            shifts = sorted((p - o, w) for p, w in enumerate(words(text)) if w in terms for o, x in enumerate(v) if x == w)
            for at in {s for s, _ in shifts}:
                near = {w for s, w in shifts if at <= s <= at + slop}
                if len(near) >= need:
                    out.add((i, str(item), at, len(near)))
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 13, 14, 30]), 6)) for i in range(20)] + [(20, None), (21, "--"), (22, "Über ß"), (23, "rare rare rare")]
    items.append((24, items[5][1]))
    docs = [None, "", "...", "über ß UBER", "rare rare rare rare"]
    for _ in range(80):
        parts = [prose(rng, rng.randrange(30), 6)]
        for _ in range(rng.randrange(3)):
            v = rng.choice(items)[1] or ""
            parts += [rng.choice([v, v.upper(), v.replace(" ", ", "), " ".join(v.split()[3:]), " ".join(v.split()[:14])]), prose(rng, rng.randrange(40), 6)]
        docs.append(" ".join(parts))
    docs += [docs[9], docs[10]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = table(spark, docs, [*range(len(docs) - 1), 10])
    rows = [(r["doc_id"], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in decontaminate.contamination(df, bench).collect()]
    want = [(i, plain_contamination(d, items)) for i, d in zip([*range(len(docs) - 1), 10], docs, strict=True)]
    assert sorted(rows) == sorted(want)
    kept = Counter(r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect())
    assert kept == Counter(i for i, x in want if not x[4])
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    got = Counter((r["id"], r["item_id"], r["position"], r["n_terms"]) for r in decontaminate.proximity_matches(df, bench).collect())
    want = plain_proximity([(i, d) for i, d in zip([*range(len(docs) - 1), 10], docs, strict=True)], items)
    assert len(want) > 50 and set(got) == want
    near = Counter((r["doc_id"], r["n_near"]) for r in decontaminate.contamination(df, bench).collect())
    assert near == Counter((i, len({(a, b) for a, b, *_ in plain_proximity([(i, d)], items, docs) if a == i})) for i, d in zip([*range(len(docs) - 1), 10], docs, strict=True))


def test_proximity_of_a_changed_passage(spark):
    words = [f"w{i}" for i in range(25)]
    docs = [" ".join(words), " ".join([*words[:12], "other", *words[13:]]), " ".join(words[:10] + ["z"] * 9 + words[10:]), "w0 " + "z " * 20 + "w1"]
    bench = spark.createDataFrame([(1, docs[0])], "item_id long, text string")
    got = {(r["doc_id"], r["n_items"] > 0, r["n_near"]) for r in decontaminate.contamination(table(spark, docs), bench).collect()}
    assert got == {(0, True, 1), (1, False, 1), (2, True, 1), (3, False, 0)}


# --- op6 --------------------------------------------------------------------


def plain_lines(docs):
    """(doc, line, reason) by comparing each line with all earlier ones; ids are in order."""
    seen, out = [], set()

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        n = max(len(a), len(b))
        p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return p + s >= n - 1

    for d, t in enumerate(docs):
        for k, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if not w:
                continue
            if any(w == v for v in seen):
                out.add((d, k, "exact"))
            elif any(max(len(v), len(w)) >= 10 and near(w, v) for v in seen):
                out.add((d, k, "near"))
            seen.append(w)
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [prose(rng, n, 300) for n in (9, 10, 11, 12, 13, 24, 25, 47, 48, 49, 60, 130, 300)]
    docs = [None, "", "\n \n"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                i, how = rng.randrange(len(w)), rng.randrange(3)
                w[i : i + (how != 0)] = [] if how == 2 else [f"new{rng.randrange(9)}"]
            lines.append(rng.choice(["", "  "]) + rng.choice([" ", " ", "\t"]).join(w).replace("a", rng.choice("aA")))
        docs.append("\n".join(lines))
    df = table(spark, docs)
    got = {(r["id"], r["line_no"], r["reason"]) for r in linededup.line_decisions(df).collect()}
    assert got == plain_lines(docs)
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    gone = {(d, k) for d, k, _ in got}
    for d, t in enumerate(docs):
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
        if any(x == d for x, _ in gone) and not left.strip():
            assert d not in kept
        else:
            assert (kept[d] or "") == left
    assert linededup.summarise(df.limit(0)).count() == 0
    twice = linededup.summarise(table(spark, ["a b\na b", "a b\na b"], [1, 1])).collect()
    assert [r["removed_lines"] for r in twice] == [[1], [1]]


def test_line_dedup_of_repeated_rows(spark):
    line = "one two three four five six seven eight nine ten"
    ids, docs = [1, 1, 2, None, None], [line, line, line + " more", "x " + line, "x " + line]
    got = {(r["id"], r["reason"]) for r in linededup.line_decisions(table(spark, docs, ids)).collect()}
    assert got == {(2, "near"), (None, "near")}
    assert [r["doc_id"] for r in linededup.dedup_lines(table(spark, docs, ids)).collect()] == [1, 1]


def test_line_dedup_at_the_least_length(spark):
    nine = " ".join(f"w{i}" for i in range(9))
    docs = [nine, nine + " w9", nine.replace("w4", "x"), nine + " w9 w10", " ".join(f"v{i}" for i in range(10)), " ".join(f"v{i}" for i in range(9))]
    got = {(r["id"], r["reason"]) for r in linededup.line_decisions(table(spark, docs)).collect()}
    assert got == {(1, "near"), (3, "near"), (5, "near")}  # of nine words and nine, neither has ten


def test_coarse_keys_lose_no_edit(spark):
    pairs = []
    for n in (9, 10, 11, 16, 17, 33):
        line = [f"w{i}" for i in range(n)]
        for at in range(n + 1):
            pairs.append((line, line[:at] + ["x"] + line[at:]))
            if at < n:
                pairs += [(line, line[:at] + line[at + 1 :]), (line, line[:at] + ["x"] + line[at + 1 :])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    halves = lambda c: linededup.half_keys(F.col(c), F.size(c))
    eighths = lambda c: linededup.stretch_keys(F.transform(c, lambda w: F.xxhash64(w)))
    for keys in (halves, eighths):
        assert df.where(~F.arrays_overlap(keys("a"), keys("b"))).count() == 0


# --- op7 --------------------------------------------------------------------


def plain_simhash(text):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = {f: {g for g in fps if (f ^ g).bit_count() <= 3} for f in fps}
    out = {}
    for f in fps:
        seen, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += root[x]
        out[f] = min((i for i, g in zip(ids, fps, strict=True) if g in seen and i is not None), default=None)
    return out


def test_simhash(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "one", "One TWO", "Éa b c d"]
    base = [prose(rng, 300, 500) for _ in range(12)]
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(w))
    ids = [*range(len(texts) - 2), 500, None]
    df = table(spark, texts, ids)
    fps = [plain_simhash(t) for t in texts]
    comp = plain_components(ids, fps)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter((i, f"{f:016x}", comp[f]) for i, f in zip(ids, fps, strict=True))
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(comp.values())) and {r["doc_id"] for r in kept} == set(comp.values())
    assert simhash.keep_one(table(spark, ["same text here"] * 3, [1, 1, 1])).count() == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_links_in_dense_blocks(spark, monkeypatch):
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        fps |= {f ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = plain_components(range(len(fps)), fps)
    for rows in (simhash.BLOCK_ROWS, 20, 3):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
        links = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        parent = {f: f for f in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        assert len({find(f) for f in fps}) == len(set(want.values()))


# --- op8 --------------------------------------------------------------------


def test_ann_recall_and_cases(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    got = {}
    for r in annsearch.search(df, asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        best = set(np.argsort(-s)[:20].tolist())
        hits += len(best & {v for _, v, _ in found})
        assert [k for k, *_ in sorted(found)] == list(range(1, 21)) and all(abs(score - s[v]) < 1e-12 for _, v, score in found)
    assert hits / (20 * len(got)) >= 0.9

    odd = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 0.0])]
    small = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in annsearch.search(small, small.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (0, 3, 20, 1.0), (0, 4, 20, 0.5)]
    assert annsearch.search(small.limit(0), small).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_ann_share_is_measured(spark, clustered):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12_000, 32)) + (rng.normal(size=(30, 32)) * 3)[rng.integers(0, 30, 12_000)] * clustered
    books = annsearch.fit(x)
    share = annsearch.needed_share(x, books, 20)
    assert 0.2 < share < 0.9 if not clustered else share < 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in annsearch.search(df, df.where("vec_id % 100 = 0"), least=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -1e9
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 120 and hits / 2400 >= 0.9


def test_ann_recall_on_embeddings(spark):
    """All queries of the registered query, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    got = {}
    for r in annsearch.search(df, df.where("vec_id % 20 = 0"), least=0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(found) & set(sorted((i for i in x if i != q), key=lambda i: -(x[i] @ x[q]))[:20])) for q, found in got.items())
    assert len(got) == sum(i % 20 == 0 for i in x) and hits / (20 * len(got)) >= 0.9


def test_ann_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.5, 0.0]), (None, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in annsearch.search(df, df).collect())
    assert got == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]


def test_multi_sequence_walk():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    sizes = rng.integers(0, 3, size=(7, 5))
    order = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5) if sizes[i, j])
    assert annsearch.walk(a, b, sizes, 10**9) == [(i, j) for _, i, j in order]


# --- op9 --------------------------------------------------------------------


def plain_repeats(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((len(t), sum(m), spans, hashlib.sha256(bytes(b for b, x in zip(t, m, strict=True) if not x)).hexdigest()))
    return out


def test_identifiers_name_spans():
    """Spans have one identifier if and only if their bytes are equal."""
    rng = np.random.default_rng(3)
    data = np.tile(rng.integers(97, 99, 300).astype(np.uint8), 4)
    ids = suffixdedup.Identifiers(data, suffixdedup.BASES[0], 5)
    start = rng.integers(0, 600, 5000)
    stop = start + rng.integers(5, 500, 5000)
    by_id, by_bytes = {}, {}
    for i, (a, b) in enumerate(zip(start, stop, strict=True)):
        by_id.setdefault(int(ids.of(start[i : i + 1], stop[i : i + 1])[0]), set()).add(i)
        by_bytes.setdefault(data[a:b].tobytes(), set()).add(i)
    assert sorted(map(sorted, by_id.values())) == sorted(map(sorted, by_bytes.values()))


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(150, 900))) for _ in range(10)]
    docs = [None, "", "a" * 1000, "ab" * 400, "z" * 199, "z" * 200, "é" * 250]
    for _ in range(50):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b) // 2)
            t += b[i : i + rng.randint(100, 600)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
        docs.append(t)
    docs += [docs[9], docs[10] + "q", docs[11]]
    ids = [*range(len(docs) - 1), 11]
    got = Counter((r["doc_id"], *list(r)[1:]) for r in suffixdedup.remove_repeats(table(spark, docs, ids)).collect())
    want = Counter((i, *x) for i, x in zip(ids, plain_repeats([(d or "").encode() for d in docs], 200), strict=True))
    assert got == want
    assert suffixdedup.remove_repeats(table(spark, [])).count() == 0


# --- op10 -------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(7)
    good = [prose(rng, 60, 30) for _ in range(150)]
    bad = ["$$$ ### " * 40 + prose(rng, 5) for _ in range(50)]
    texts = [*good, *bad, None, "", "word " * 300_000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.sample(docs, labels).collect()}
    assert len(rows) == len(texts)
    held = range(1, 200, 2)
    assert sum(rows[i]["selected"] == (i < 150) for i in held) / len(held) >= 0.95
    assert rows[200]["log_weight"] == 0 and rows[201]["n_grams"] == 0
    kept = {r["doc_id"] for r in quality.keep_selected(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r["selected"]}
    assert quality.keep_selected(docs, labels).columns == docs.columns
    assert quality.sample(docs.limit(0), labels).count() == 0
    assert quality.sample(docs, labels.limit(0)).count() == len(texts)


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "sample_key double")
    for k in (1, 7, 5000, 12_000, 20_000):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_ngrams_do_not_depend_on_cuts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "Abc ", "  ", "$$$ ", "12 ", "so so ", "x" * rng.randrange(30), "\n"]) for _ in range(2000)).encode()
    flat, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    want = np.sort(quality.ngrams(flat, bounds)[0])
    for block in (7, 64, 999):
        monkeypatch.setattr(quality, "BLOCK", block)
        quality._powers.cache_clear()
        parts = [quality.ngrams(part, ends, seen)[0] for part, ends, _, seen in quality._pieces(flat, bounds)]
        assert len(parts) > 9 and np.array_equal(np.sort(np.concatenate(parts)), want)
    quality._powers.cache_clear()


def plain_ngrams(text):
    """Buckets of a text's n-grams, word by word."""
    kind = lambda c: "W" if c >= 128 or chr(c).isalnum() else " " if c < 33 or c == 127 else "M"
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 33

    words, data = [], text.encode()
    for i, c in enumerate(data):
        if kind(c) != " ":
            if i and kind(c) == kind(data[i - 1]):
                words[-1].append(c)
            else:
                words.append([c])
    keys, shapes = [], []
    for w in words:
        keys.append(mix((sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & m))
        caps, nums = sum(65 <= c < 91 for c in w), sum(48 <= c < 58 for c in w)
        shape = 5 if kind(w[0]) == "M" else 4 if nums == len(w) else 3 if caps == len(w) > 1 else 2 if caps else 1
        shapes.append(shape + 8 * (len(keys) > 1 and keys[-1] == keys[-2]))
    pairs = [mix((a * 31 + b) & m) for a, b in zip(keys, keys[1:], strict=False)]
    kinds = [mix(a * 64 + b + (1 << 20)) for a, b in zip(shapes, shapes[1:], strict=False)]
    return [k >> 48 for k in keys + pairs + kinds]


def test_quality_against_plain_arithmetic(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["Ab", "cd", "EF", "12", "ü", "$$", "a1", "cd cd"])
    texts = ["".join(word() + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(40))) for _ in range(40)] + [None, "", "cd", "cd"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    wanted = {i: int(i % 3 > 0) for i in range(0, 40, 2)}
    labels = spark.createDataFrame(list(wanted.items()), "doc_id long, quality int")
    rows = quality.sample(table(spark, texts, ids), labels).collect()
    grams = [plain_ngrams(t or "") for t in texts]

    def log_model(of):
        n = Counter(b for i, g in enumerate(grams) if of(ids[i]) for b in g)
        total = sum(n.values()) + 65_536
        return lambda b: np.log((n[b] + 1) / total)

    target, raw = log_model(lambda i: wanted.get(i) == 1), log_model(lambda i: True)
    weight = [float(sum(target(b) - raw(b) for b in g)) for g in grams]
    got = sorted((r["doc_id"], r["n_grams"], round(r["log_weight"], 6)) for r in rows)
    assert got == sorted((i, len(g), round(w, 6)) for i, g, w in zip(ids, grams, weight, strict=True))
    # the cut: of all bins' upper ends within the slack of the best, the lowest
    bins = {}
    for i, w in zip(ids, weight, strict=True):
        if i in wanted:
            b = int(np.floor(np.sign(w) * np.log1p(abs(w)) * 256))
            bins.setdefault(b, [0, 0])[wanted[i]] += 1
    n = [sum(v[k] for v in bins.values()) for k in (0, 1)]
    parted = []
    for b in sorted(bins):
        below = [sum(v[k] for c, v in bins.items() if c <= b) for k in (0, 1)]
        x = (b + 1) / 256
        parted.append((below[0] / n[0] - below[1] / n[1], np.sign(x) * np.expm1(abs(x))))
    best = max(p for p, _ in parted)
    cut = min(c for p, c in parted if p >= best - quality.SLACK)
    k = sum(w >= cut for w in weight)
    # the k largest of log weight and Gumbel noise, the noise from the hash of seed, id and weight
    noise = {(r["i"], r["w"]): r["x"] for r in spark.createDataFrame([(i, round(w, 6)) for i, w in zip(ids, weight, strict=True)], "i long, w double").selectExpr("i", "w", "xxhash64(42, i, w) AS x").collect()}
    keys = [w - np.log(-np.log((((noise[i, round(w, 6)] % (1 << 64)) >> 11) + 0.5) / 2**53)) for i, w in zip(ids, weight, strict=True)]
    assert 0 < k < len(texts)
    least = sorted(keys, reverse=True)[k - 1]
    assert sorted((r["doc_id"], r["selected"]) for r in rows) == sorted((i, x >= least - 1e-9) for i, x in zip(ids, keys, strict=True))


def test_ngrams_do_not_depend_on_the_block(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(50)).encode() for _ in range(30)]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    bucket, row = quality.ngrams(flat, bounds)
    for i, t in enumerate(texts):
        alone = quality.ngrams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert sorted(bucket[row == i].tolist()) == sorted(alone.tolist())


def test_no_python_in_native_operators(spark):
    docs = table(spark, ["a b c d e f g h i j k l m n"])
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    for df in (decontaminate.contamination(docs, bench), linededup.summarise(docs), chatformat.rotate(turns)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("few", [500_000, 0])
def test_repeats_of_ids_with_any_name(spark, monkeypatch, few):
    """Id columns named as columns inside, texts of several parts, and both ways to bring removals to texts."""
    monkeypatch.setattr(suffixdedup, "FEW_KEYS", few)
    rng = random.Random(12)
    big = "".join(rng.choice("abcdefgh") for _ in range(1_200_000))
    texts = {1: big, 2: "x" + big[1_040_000:1_050_000] + "y", 3: "short", 4: None, 5: big[:150]}
    kept = {1: big[:1_040_000] + big[1_050_000:], 2: "xy", 3: "short", 4: "", 5: big[:150]}
    for name in ("k", "data") if few else ("h",):
        found = suffixdedup.remove_repeats(spark.createDataFrame(list(texts.items()), f"{name} long, text string"), name)
        assert found.columns == [name, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert {r[name]: r["kept_sha256"] for r in found.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}


def test_items_without_id_count(spark):
    """Items without an id count as one item, as in the query's SQL, and are no part of the digest."""
    docs = table(spark, ["one two three", "four five", "six"])
    bench = spark.createDataFrame([("a", "one two"), (None, "two three"), (None, "one two three"), (None, "five")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(docs, bench).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: (3, 2, digest("a")), 1: (1, 1, digest("")), 2: (0, 0, digest(""))}


def test_null_ids_are_kept_apart(spark):
    docs = table(spark, ["a b c", None], [None, None])
    assert linededup.summarise(docs).count() == 2
    assert docs.where(F.col("doc_id").isNull()).count() == simhash.near_duplicates(docs).count()
