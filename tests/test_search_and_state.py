import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.functions import classify
from tarnweave.operators import evaluation, lexicon, retrieval, review, sessions
from tarnweave.sources import plugins, sinks
from tarnweave.streaming import keyed, stateful


def test_bm25_against_plain(spark):
    rng = random.Random(3)
    docs = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(docs)), "chunk_id long, content string"))
    got = {(r["doc_id"], r["rank"]) for r in retrieval.bm25(index, spark.createDataFrame([(0, "c h h")], "query_id long, query string"), 5).collect()}
    toks = [d.split() for d in docs]
    n, mean = len(docs), sum(map(len, toks)) / len(docs)
    raw = {t: math.log(n - sum(t in d for d in toks) + 0.5) - math.log(sum(t in d for d in toks) + 0.5) for t in set(sum(toks, []))}
    avg = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * avg for t, v in raw.items()}
    score = [round(sum(idf[q] * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for q in "c h h".split()), 9) for d in toks]
    if max(score) > 0:
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-score[i], i))[:5]
        assert got == {(d, k) for k, d in enumerate(want, 1)}


def test_bounds_drop_postings_and_no_text(spark):
    """The pruned search gives the rows of the whole one, ties and queries of common, rare and unknown words included."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(12_000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(4)] + [(404, None), (405, "")]
    index = retrieval.build_index(spark.createDataFrame(docs, "chunk_id long, content string"))
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20)))) for i in range(40)] + [(40, docs[7][1]), (41, "unknown"), (42, None), (43, "w1 w1 w1")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    rows = lambda **how: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["raw_score"], 7), r["score"]) for r in retrieval.bm25(index, queries, 3, **how).collect())
    whole = rows()
    assert len(whole) > 100 and rows(few=0, seeds=2) == whole and rows(few=0, seeds=10_000) == whole
    assert rows(held=0) == whole and rows(held=0, few=0, seeds=2) == whole and rows(held=0, few=0, seeds=10_000) == whole


def test_few_queries_move_no_postings_and_no_vectors(spark, monkeypatch):
    """Texts and vectors pass by the queries once, in any split into steps; the rows are those of joins and blocks."""
    from pathlib import Path

    from tarnweave.session import scratch_root

    monkeypatch.setattr(retrieval, "SCORES", 40)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 12)))) for i in range(90)] + [(90, None)]
    index = retrieval.build_index(spark.createDataFrame(docs, "chunk_id long, content string").repartition(3))
    queries = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, "z"), (4, "g a d e f")], "query_id long, query string")
    rows = lambda **how: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["raw_score"], 7), r["score"]) for r in retrieval.bm25(index, queries, 4, **how).collect())
    written = lambda: set(Path(scratch_root(spark).removeprefix("file:")).glob("tarnweave/index-postings*"))
    before, whole = written(), rows()
    assert len(whole) >= 8 and written() == before and rows(held=0) == whole
    x = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)], i % 2) for i in range(50)], "vec_id long, embedding array<double>, half long")
    for how in ({}, {"measure": "l2", "partition": "half"}):
        near = retrieval.nearest(x, x.where("vec_id < 9"), 4, **how)
        assert "REPARTITION" not in near._jdf.queryExecution().toString()
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, retrieval.nearest(x, x.where("vec_id < 9"), 4, held=0, **how).collect()))


def test_large_lexicons(spark):
    """Terms of any length by their grams; a lexicon beyond the list gives what the list gives."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé她x ") for _ in range(n))
    terms = [word(rng.randrange(1, 9)) for _ in range(500)] + ["", None, "(.*)", "ABC"]
    texts = [(i, word(rng.randrange(60)).upper()) for i in range(60)] + [(None, "abc abc"), (3, "abcabc"), (61, None), (62, ""), (63, "x(.*)\nabcab")]
    got = {(r["doc_id"], r["term"]) for r in lexicon.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, t.lower()) for i, x in texts for t in terms if t and t.lower() in (x or "").lower()}
    odd = spark.createDataFrame(texts + [(70, "ÄÖabcü" * 90), (71, "x" * 9), (70, "ZZ she")], "doc_id long, text string")
    wanted = spark.createDataFrame([(t,) for t in [*terms, "öabcüä", "she", "xxxxxxxxx", "ü", "zz"]], "term string")
    held, joined = ([tuple(r) for r in lexicon.matches(odd, wanted, held=n).collect()] for n in (lexicon.HELD, 0))
    assert len(held) == len(set(held)) and set(held) == set(joined) and (70, "öabcüä") in held
    plan = lexicon.matches(odd.where("doc_id > 3"), wanted)._jdf.queryExecution().toString()
    assert "(?s)(?=(" not in plan  # no row for each gram of a text
    entries = [(k, f"t{k % 40}", [word(3), word(4)], [f"z{k % 7}"], [f"e{k % 5}"]) for k in range(60)]
    lex = spark.createDataFrame(entries, "place int, topic string, triggers array<string>, zh_terms array<string>, en_terms array<string>")
    asked = spark.createDataFrame([(i, t) for i, t in texts if t is not None] + [(1, texts[1][1])], "query_id long, query string")
    rows = lambda n: sorted(map(str, retrieval.rewrite_queries(asked, lex, listed=n).select("query_id", "cleaned_query", "matched_topics", "en_terms", "query_variants").collect()))
    assert rows(10) == rows(1_000)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "beta")], "chunk_id long, content string")
    meta = retrieval.save_index(retrieval.build_index(docs), str(tmp_path / "i"))
    assert meta["documents"] == 3 and retrieval.index_healthy(spark, str(tmp_path / "i"), 3)[0]
    again = retrieval.load_index(spark, str(tmp_path / "i"))
    rows = retrieval.bm25(again, spark.createDataFrame([(1, "alpha"), (2, "none"), (3, None)], "query_id long, query string")).collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(1, 1)]


def test_rank_fusion_prefers_both_lists(spark):
    rows = [(1, "a", "dense", 1, 0.9), (1, "b", "bm25", 1, 0.9), (1, "c", "dense", 2, 0.8), (1, "c", "bm25", 2, 0.8)]
    merged = retrieval.with_rrf(retrieval.merge_candidates(spark.createDataFrame(rows, "query_id long, chunk_id string, source string, rank int, score double")))
    best = merged.orderBy(F.desc("rrf_score")).first()
    assert best["chunk_id"] == "c" and best["retrieval_sources"] == ["bm25", "dense"] and best["rrf_score_norm"] == 1.0


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[7] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.nearest(df, df.where("vec_id < 20"), 4, block=6).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    for q in range(20):
        s = np.round(x @ x[q], 6)
        want = sorted((i for i in range(60) if i != q and s[i] > 0), key=lambda i: (-s[i], i))[:4]
        assert [got[q][k] for k in sorted(got[q])] == want
    assert retrieval.nearest(df.limit(0), df, 3).count() == 0 and retrieval.nearest(df, df.limit(0), 3).count() == 0


def test_nearest_of_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [1.0]), ("d", None), ("e", [None, 1.0]), ("f", [float("nan"), 1.0]), ("g", [float("inf"), 1.0]), ("h", []), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").withColumn("kind", F.when(F.col("vec_id") != "b", "k"))
    asked = df.where("vec_id in ('a', 'd', 'f')").union(df.where("vec_id = 'a'"))
    found = [(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.nearest(df, asked, 5, block=1).collect()]
    assert sorted(found, key=lambda r: r[2]) == [("a", "b", 1), ("a", None, 2)]
    parted = {(r["doc_id"], r["kind"], r["rank"]) for r in retrieval.nearest(df, asked, 5, "l2", partition="kind").collect()}
    assert parted == {("b", None, 1), (None, None, 2)}


def test_populations(spark):
    cases = [(["parents"], ["adults"], True, False), (["children"], ["adults"], False, False), (["children"], ["workers"], False, True), ([], ["x"], True, False), (["workers"], ["young adults"], True, False), (["a"], [], False, False)]
    df = spark.createDataFrame([(d, c) for d, c, *_ in cases], "d array<string>, c array<string>")
    got = df.select(retrieval.population_compatible(F.col("d"), F.col("c")), retrieval.population_mismatch(F.col("d"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(a, b) for *_, a, b in cases]


def test_boundary(spark):
    b = retrieval.Boundary(("suicide",), ("dose",), ("diagnose",), ("how to",))
    df = spark.createDataFrame([("how to make POISON",), ("what dose",), ("diagnose me",), ("hello",), (None,)], "q string")
    assert [r[0] for r in df.select(b.reason(F.col("q"))).collect()] == ["dangerous_instruction_out_of_scope", "medication_or_dosage_out_of_scope", "diagnosis_out_of_scope", "", ""]
    assert df.select(b.reason(F.col("q"), ["safety"])).distinct().count() == 1


RISK = classify.RiskLexicon(("自杀", "不想再撑", "want to die"), ("崩溃",), ("朋友说",), ("小说",), ("我想",), ("准备",), ("今晚",), ("药",), (), ("没有自杀的想法",))


@pytest.mark.parametrize(("said", "level", "plan", "negated"), [
    ("我准备好了药，今晚不想再撑下去了。", "high", True, False), ("我没有想过自杀，只是最近很累。", "low", False, True), ("朋友说他想自杀", "medium", False, False), ("我快崩溃了", "medium", False, False), (None, "low", False, False),
])
def test_risk(spark, said, level, plan, negated):
    r = spark.createDataFrame([(said,)], "t string").select(classify.assess_risk({"user_text": F.col("t")}, RISK).alias("r")).first()["r"]
    assert (r["level"], r["dimensions"]["plan"], r["dimensions"]["negated"]) == (level, plan, negated)
    if plan:
        assert r["dimensions"]["timeframe_present"] and r["dimensions"]["means_access"] == "present" and r["evidence"]


def test_denied_term_beside_a_medium_one(spark):
    """Beside a medium term nothing is negated, and harm to others isn't lost."""
    lex = classify.RiskLexicon(("自杀", "不想活"), ("崩溃",), others=("砍人",), denials={"不想活": ("没有不想活",)})
    said = ["我没有自杀的想法，但是快崩溃了，想砍人", "我没有自杀的想法，想砍人", "我没有不想活", "我没事，就是不想活"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", classify.assess_risk({"t": F.col("t")}, lex).alias("r")).orderBy("i").collect()
    got = [(r["r"]["level"], r["r"]["context"], r["r"]["dimensions"]["negated"], r["r"]["dimensions"]["harm_to_others"]) for r in rows]
    assert got == [("medium", "none", False, True), ("low", "negated_high_risk", True, False), ("low", "negated_high_risk", True, False), ("high", "none", False, False)]


def test_emotion_and_plan(spark):
    lex = {"joy": ("happy",), "anxiety": ("exam", "worry"), "sadness": ("sad",)}
    df = spark.createDataFrame([("exam worry sad", 8), ("lonely and sad", None), ("nothing", None), ("hopeless", 3)], "t string, s int")
    got = [r["e"] for r in df.select(classify.emotion(F.col("t"), lex, distress=("hopeless",), lonely=("lonely",), stress=F.col("s")).alias("e")).collect()]
    assert [g["label"] for g in got] == ["anxiety", "loneliness", "neutral", "sadness"]
    assert got[0]["intensity"] == 0.9 and got[0]["secondary"] == ["sadness"] and got[2]["intensity"] == 0.35 and got[3]["risk_relevant"]
    lit = lambda *xs: [F.lit(x) for x in xs]
    need = F.array(F.lit("information"))
    p = lambda risk, cause, conf: spark.range(1).select(classify.plan(*lit(risk, "anxiety", cause, "exploration"), need, F.lit(conf)).alias("p")).first()["p"]
    assert p("high", "sleep", 0.9)["primary_strategy"] == "referral" and p("low", "sleep", 0.9)["primary_strategy"] == "information" and p("low", "exam", 0.3)["primary_strategy"] == "clarification"


def test_review_rules(spark):
    rows = [("a", "s", "approved", None), ("b", "s", None, "x"), ("c", "s", "blocked", "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, review_status string, license string")
    d = spark.createDataFrame([("b", "pending", "p", 1), ("b", "reviewed", "q", 0), ("zzz", "rejected", "r", 1)], "chunk_id string, review_status string, reviewed_by string, reviewed_at int")
    got = {r["chunk_id"]: (r["review_status"], r["reviewed_by"]) for r in review.apply_history(chunks, d).collect()}
    assert got == {"a": ("approved", None), "b": ("reviewed", "q"), "c": ("blocked", None)}
    with pytest.raises(ValueError):
        review.decide(chunks, F.lit(True), "approved", " ")
    assert {r["field"]: (r["changed"], r["filled"]) for r in review.diff(chunks, chunks.fillna("y", ["license"]), "chunk_id", ["license", "source_id"]).collect()} == {"license": (1, 1), "source_id": (0, 0)}


def test_publish_and_roll_back(spark, tmp_path):
    root = str(tmp_path / "r")
    one, two = spark.range(3), spark.range(5)
    sinks.publish(one, root, lambda df: df.count() == 3)
    sinks.publish(two, root, lambda df: df.count() == 5)
    with pytest.raises(ValueError):
        sinks.publish(one, root, lambda df: df.count() == 5)
    assert sinks.current(spark, root).count() == 5
    sinks.roll_back(spark, root)
    assert sinks.current(spark, root).count() == 3


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("h1", "alpha"), ("h2", "beta"), ("h2", "beta"), ("h3", "")], "content_sha256 string, content string")
    cache = spark.createDataFrame([("m", "h1", [1.0])], "model string, content_sha256 string, embedding array<double>")
    new = sinks.embed_missing(chunks, cache, plugins.embedding("hashing-384"), "m").collect()
    assert sorted(r["content_sha256"] for r in new) == ["h2", "h3"]
    by = {r["content_sha256"]: r["embedding"] for r in new}
    assert abs(sum(x * x for x in by["h2"]) - 1) < 1e-5 and not any(by["h3"])
    with pytest.raises(ValueError):
        plugins.embedding("none")


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    d = lambda df: evaluation.table_digest(df).first()["digest"]
    assert d(a) == d(a.orderBy(F.desc("a"))) != d(a.distinct())


def test_memory_maps_and_jobs(spark):
    df = spark.sql("select map('a', array('1'), 'l', array('x')) as s, map('a', array('2'), 'l', array('y'), 'b', array('3')) as g")
    assert df.select(sessions.merge_maps(F.col("s"), F.col("g"), ["l"])).first()[0] == {"a": ["1"], "l": ["y", "x"], "b": ["3"]}
    ev = spark.createDataFrame([("j", 1, 1, "queued", 0), ("j", 2, 2, "cancelled", 500), ("j", 3, 3, "completed", 100), ("k", 1, 4, "processing", -3)], "job_id string, ts int, event_id int, status string, progress int")
    got = {r["job_id"]: (r["status"], r["progress"]) for r in sessions.job_states(ev).collect()}
    assert got == {"j": ("cancelled", 100), "k": ("processing", 0)}
    req = spark.sql("select 's' as session_id, timestamp'2024-01-01' as ts union all select 's', timestamp'2024-01-02' union all select 't', timestamp'2024-01-01'")
    act = spark.createDataFrame([("s", "processing"), ("s", "completed")], "session_id string, status string")
    assert [r["admitted"] for r in sessions.admissions(req, act, 2).orderBy("session_id", "ts").collect()] == [True, False, True]


def test_stream_restart_is_idempotent(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "session_id string, key string, value string, confidence double, confirmed boolean, updated_at long"
    row = lambda v, t: spark.createDataFrame([("s", "k", v, 0.5, False, t)], schema)
    for i, v in enumerate("ab"):
        row(v, i).write.mode("append").parquet(src)
        stream = stateful.memory_upserts(spark.readStream.schema(schema).parquet(src))
        stateful.run_available(stream, check, "update", keyed.KeyedTable(out, ("session_id", "key")).write)
    assert [r["value"] for r in keyed.KeyedTable(out, ("session_id", "key")).read(spark).collect()] == ["b"]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "query_id long, rank int, source_id string")
    t = spark.createDataFrame([], "query_id long, source_id string")
    assert evaluation.retrieval_report(evaluation.retrieval_rows(e, t)).first()["query_count"] == 0
    c = spark.createDataFrame([], "expected string, predicted string")
    assert evaluation.classification_report(c).first()["accuracy"] == 0.0


def test_safety_misses_are_whole(spark):
    cases = [(i, "high", "low" if i % 2 else None) for i in range(250)] + [(i, "low", "high") for i in range(250, 400)] + [(400, None, "high"), (401, "high", "high"), (402, "low", "low")]
    rows = spark.createDataFrame([(*c, True, True, False, True) for c in cases], "case_id long, expected string, predicted string, negated_expected boolean, negated_predicted boolean, third_party_expected boolean, third_party_predicted boolean")
    got = {(r["case_id"], r["kind"]) for r in evaluation.safety_misses(rows).collect()}
    assert got == {(i, "missed_high_risk") for i in range(250)} | {(i, "false_positive") for i in range(250, 401)}
    r = evaluation.safety_report(rows).first()
    assert (r["high_risk_false_negative_count"], r["high_risk_false_positive_count"]) == (250, 151)


def test_risk_parts_are_computed_once(spark):
    """A text is stripped a few times a row, not once for every term and field that looks at it."""
    from tarnweave.plans.rules import RISK

    rows = spark.createDataFrame([("not a tion but with ment",), (None,), ("",)], "t string").select(classify.assess_risk({"text": F.col("t")}, RISK).alias("r"))
    rows = rows.select("r.level", "r.matched_terms", "r.dimensions.negated", "r.dimensions.plan", "r.evidence")
    assert [r["level"] for r in rows.collect()][1:] == ["low", "low"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 12
