"""The pipeline against a brute-force version over the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from tarnweave.llm import quality
from tarnweave.llm.queries import vocabulary
from tests.llm.test_operators import plain_components, plain_contamination, plain_lines, plain_simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the tables")


def test_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    chosen = {r["doc_id"] for r in quality.sample(docs, labels).where("selected").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & chosen) >= 0.97 * len(good)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in chosen)

    gone = {(d, k) for d, k, _ in plain_lines([t for _, t in rows])}
    left = []
    for n, (i, t) in enumerate(rows):
        new = "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in gone)
        if new.strip() or not any(d == n for d, _ in gone):
            left.append((i, new))
    fps = [plain_simhash(t) for _, t in left]
    comp = plain_components([i for i, _ in left], fps)
    left = [(i, t) for (i, t), f in zip(left, fps, strict=True) if comp[f] == i]
    left = [(i, t) for i, t in left if not plain_contamination(t, bench)[4]]
    t = tokenizers.Tokenizer.from_file(vocabulary())
    want = {i: (len(text), t.encode(text, add_special_tokens=False).ids, True) for i, text in left}
    got = {r["doc_id"]: (r["n_chars"], r["ids"], r["decodes"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_columns_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_odd_rows_and_settings(spark):
    """Nulls, empty and very long texts, repeats and clashing names pass every stage; the caller's settings stay."""
    prose = " ".join(f"word{i % 97} and{i % 31}" for i in range(40))
    texts = [None, "", " \n ", prose, prose, prose + " more", "one\ntwo\none", "x" * 300_000, "\n".join(f"line {i} of a long text" for i in range(20_000)), "é" * 50]
    rows = [(i if i != 3 else None, t, "en", "s", None if t is None else len(t), "a", 1, "w") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], rows[0]], "doc_id long, text string, lang string, source string, n_chars long, id string, h int, words string")
    before = dict(spark.conf.getAll)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert [c for c in out.columns if c not in ("ids", "decodes", "n_tokens")] == [c for c in docs.columns if c in out.columns], name
        found = out.collect()
        assert len(found) <= 12 and {r["doc_id"] for r in found} <= {r[0] for r in rows}, name
        if name in ("decontamination", "tokens"):
            assert len(found) == 12, name
        if name == "near_duplicates":
            assert sum(r["doc_id"] == 4 for r in found) <= 1 and {r["doc_id"] for r in found} >= {7, 8}
    assert {k: v for k, v in dict(spark.conf.getAll).items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}
