import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import text
from tarnweave.operators import knowledge, leakage
from tarnweave.sources import files, json_arrays


def test_clean_documents(spark):
    body = "﻿Title\r\nPage 3/10\n- 4 -\nSkip to main content\n" + "Menu\n" * 4 + "\n\n\nFirst   paragraph that is long enough to be a key of its own.\n\nfirst paragraph that is long enough to be a key of its own.\n\nshort\n\nshort"
    got = knowledge.clean_documents(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert rows == {1: "Title\n\nFirst paragraph that is long enough to be a key of its own.\n\nshort\n\nshort", 2: "", 3: ""}


def test_sections(spark):
    md = spark.createDataFrame([(1, "before\n# One\na\n\nb\n## \nc\n# Two"), (2, None)], "doc_id long, text string")
    got = [(r["section"], r["content"]) for r in knowledge.markdown_sections(md).orderBy("doc_id", "section_no").collect()]
    assert got == [("1", "before"), ("One", "a\n\nb"), ("1", "c")]
    plain = spark.createDataFrame([(1, "Intro\n\nSome text, with a comma.\n\n1. Next part\n\nMore text; here.")], "doc_id long, text string")
    got = [(r["section"], r["content"]) for r in knowledge.plain_sections(plain).orderBy("section_no").collect()]
    assert got == [("Intro", "Some text, with a comma."), ("1. Next part", "More text; here.")] or got[0] == ("Intro", "Some text, with a comma.")


def test_json_sections(spark):
    one = json.dumps({"title": "T", "content": "c", "sections": [{"title": "A", "text": "x"}, "y"]})
    two = json.dumps([{"section": "B", "content": "z"}, "w", {"content": " "}])
    got = knowledge.json_sections(spark.createDataFrame([("f", one), ("g", two)], "doc_id string, text string")).orderBy("doc_id", "section_no").collect()
    assert [(r["section"], r["content"]) for r in got] == [("T", "c"), ("A", "x"), ("T-2", "y"), ("B", "z"), ("g-2", "w")]


def test_chunking():
    assert knowledge.chunk_texts("") == []
    assert knowledge.chunk_texts("a. " * 10) == [("a. " * 10).strip()]
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    pieces = knowledge.chunk_texts(long, limit=200)
    assert all(len(p) <= 200 for p in pieces[:-1]) and " ".join(pieces).startswith("Sentence number 0")
    assert knowledge.split_long("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9, "x"]
    assert knowledge.overlapped_windows("abc。def。ghi。", 6, 2) == ["abc。", "c。def。", "f。ghi。"]
    steps = "intro\n\nstep 1 do\n\nstep 2 do"
    assert knowledge.chunk_texts(steps, target=5, least=0) == [steps]


def test_chunk_table(spark):
    rows = [("s", 0, "How to cope", "Postpartum anger and small step plans. " * 4), ("s", 1, "x", "lethal dose 论文压力很大" + "很" * 30)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index long, section string, content string")
    got = knowledge.chunk_table(df).orderBy("chunk_index").collect()
    assert got[0]["topic_tags"] == ["anger", "postpartum", "perinatal"] and got[0]["chunk_type"] == "intervention_step"
    assert got[0]["population_tags"][:3] == ["university_students", "young_adults", "adults"] and "postpartum_people" in got[0]["population_tags"]
    assert got[1]["exclude_from_index"] and got[1]["language"] == "zh-CN" and got[1]["chunk_id"].split("_")[2] == "00001"


def test_html():
    page = "<html><head><title>T x</title><style>p{}</style></head><body><nav><p>no</p></nav><div class='menu big'><p>no</p></div><h1>H</h1><ul><li>a <p>b</p></li></ul><p>Take one<br> small step.</p><script>x</script></body></html>"
    assert files.page_text(page) == "T x\n\nH\n\na b\n\nb\n\nTake one small step."
    assert files.page_text("") == "" and files.page_text("<p>open") == "open"


def docx(lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p xmlns:w="{w}"><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<d>{body}</d>")
    return out.getvalue()


def test_document_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "b.docx").write_bytes(docx(["one", "", "two, three."]))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "c.jsonl").write_text('{"title": "X", "content": "line"}\n\nnot json\n')
    (tmp_path / "d.html").write_text("<p>Hello, world.</p>")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "e.md").write_text("# no")
    docs = files.documents(files.binary_files(spark, str(tmp_path)))
    assert {r["error"] for r in docs.collect()} == {None, "not a DOCX file"}
    got = {(r["section"], r["content"]) for r in files.sections(docs).collect()}
    assert got == {("A", "text"), ("one", "two, three."), ("X", "line"), ("c-2", "not json"), ("d", "Hello, world.")}


def test_unsafe_zip(spark, tmp_path):
    for name, member in (("ok.zip", "x/y.txt"), ("bad.zip", "../y.txt")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, "v")
    read = lambda n: files.zip_members(spark.read.format("binaryFile").load(str(tmp_path / n)))
    assert [r["member"] for r in read("ok.zip").collect()] == ["x/y.txt"]
    with pytest.raises(Exception, match="unsafe path"):
        read("bad.zip").collect()


def test_json_scans(spark, tmp_path):
    (tmp_path / "list.json").write_text('﻿[{"a": 1}, {"a": 2}]')
    (tmp_path / "map.json").write_text('{"x": {"a": 3}}')
    assert sorted(r["a"] for r in json_arrays.json_records(spark, str(tmp_path), "a int").collect()) == [1, 2, 3]
    assert files.jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.json").write_text(json.dumps({"q": [{"text": "a text of twenty signs or more"}], "text": "short"}))
    assert [r["text"] for r in files.text_items(spark, str(tmp_path / "t")).collect()] == ["a text of twenty signs or more"]


def test_leakage(spark):
    items = spark.createDataFrame([(1, "Straße der alten Bäume am Fluss"), (2, "short"), (3, "nowhere to be found in there")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "STRASSE, der alten Bäume am Fluss!"), (2, "x strassederaltenbäume am fluss"), (3, "und die Straße der  alten Bäume am Fluss liegt da"), (4, None)], "id long, text string")
    got = leakage.against_corpora(items, {"docs": docs}).collect()
    assert [(r["bench_id"], r["method"], r["n"]) for r in got] == [("1", "normalized", 1)]
    assert leakage.verdict(leakage.against_corpora(items, {"docs": docs})).first()["status"] == "fail"
    sub = leakage.substrings(items, docs.withColumnRenamed("id", "doc_id")).collect()
    assert [(r["chunk_id"], r["query_id"]) for r in sub] == [(3, 1)]


def test_scalars(spark):
    df = spark.createDataFrame([("a, b；c", '["x", " "]', "Yes", "<think>no</think> 'reply'", '```json\n{"a": 1}\n```', "AA-b/c d!")], "a string, b string, c string, d string, e string, f string")
    r = df.select(text.parse_list(F.col("a")), text.parse_list(F.col("b")), text.lenient_bool(F.col("c")), text.after_thinking(F.col("d")), text.json_object_in(F.col("e")), text.metadata_key(F.col("f"))).first()
    assert list(r) == [["a", "b", "c"], ["x"], True, "reply", '{"a": 1}', "aa_b_c_d"]
    u = spark.createDataFrame([(["A b", "a  B", " ", "c"],)], "v array<string>")
    assert u.select(text.distinct_ignoring_case(F.col("v"))).first()[0] == ["A b", "c"]
    assert u.select(text.extend_unique(F.col("v"), F.array(F.lit("C"), F.lit("d")))).first()[0] == ["A b", "a  B", "c", "d"]
    z = spark.createDataFrame([("论文 abc_1",)], "t string")
    assert z.select(text.lexical_tokens(F.col("t"))).first()[0] == ["abc_1", "论", "文", "论文"]


def test_cases_and_decisions(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"case_id": "b", "dataset": "d", "turns": ["x", {"role": "user", "content": "y"}], "tags": ["t"], "expected": {"level": "high"}}\n\n{"case_id": "a", "dataset": "d"}\n')
    rows = files.cases(spark, str(tmp_path / "c.jsonl"))
    got = {r["case_id"]: (r["turns"], r["expected"]) for r in rows.collect()}
    assert got["b"] == (["x", "y"], '{"level":"high"}') and got["a"][0] is None
    assert [r["case_id"] for r in files.cases(spark, str(tmp_path / "c.jsonl"), 1).collect()] == ["a"]
    declared = spark.createDataFrame([("d",), ("e",)], "dataset string")
    assert {r["dataset"]: (r["n"], r["ready"]) for r in files.pack_catalogue(rows, declared).collect()} == {"d": (2, True), "e": (0, False)}
    (tmp_path / "r.csv").write_text("\ufeffchunk_id,decision,reviewed_by\n1,approve,me\n2,reject,\n3,what,me\n4,Rejected,me\n", encoding="utf-8")
    assert [(r["chunk_id"], r["review_status"]) for r in files.review_decisions(spark, str(tmp_path / "r.csv")).orderBy("chunk_id").collect()] == [("1", "approved"), ("4", "rejected")]


def test_windows_of_many_texts_are_flat_numbers():
    """A batch's windows take the bytes of their hashes, twice at most while they are put together, and not an object each."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(1)
    texts = pa.array([rng.randbytes(5_000) for _ in range(200)] + [None, b"", b"short"], pa.binary())
    run = leakage._least_windows(16, 3).func
    tracemalloc.start()
    found = run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(found.flatten())
    assert n > 300_000 and peak < 24 * n and found.to_pylist()[200:] == [[], [], []]


def test_chunk_lists_are_chunks_without_a_shuffle(spark):
    """Sections and chunks of whole rows are those of section rows, and no text is dealt out by its document."""
    texts = ["Intro text. " * 120 + "\n\nHeading one\n\n" + "Body here. " * 30 + "\n\nHeading two\n\n\n\nLast one\n\n" + "word " * 400, "Only heading", "", None, "no heading, but text"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    lists = knowledge.chunk_section_lists(knowledge.plain_section_lists(docs, keep=["lang"]))
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    want = knowledge.chunk_sections(knowledge.plain_sections(docs)).collect()
    got = lists.select("doc_id", "section", "chunk_index", "content").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 5
    assert {r["section"] for r in got} >= {"0", "Heading one", "Last one", "4"}


def test_labels_lower_a_text_once(spark):
    docs = spark.createDataFrame([("Grief and ANGER",), (None,)], "text string")
    out = docs.select(text.extend_unique(F.array(F.lit("Anger")), text.matching_labels(F.col("text"), knowledge.TOPIC_RULES)).alias("tags"))
    assert [r["tags"] for r in out.collect()] == [["Anger", "grief"], ["Anger"]]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(coalesce(text") == 1


def test_leak_keys_are_hashed_once(spark):
    rows = spark.createDataFrame([(1, "A text that is long enough."), (2, "a text, that is long enough!")], "item_id long, text string")
    corpus = rows.withColumnRenamed("item_id", "id")
    found = leakage.against_corpora(rows, {"one": corpus, "two": corpus})
    # two keys for each corpus; those of the benchmark are settled
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 4
    got = {(r["bench_id"], r["method"], r["corpus"], r["n"]) for r in found.collect()}
    assert got == {(i, m, c, n) for i in "12" for c in ("one", "two") for m, n in (("exact", 1), ("normalized", 2))}
