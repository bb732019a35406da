"""Tables of one row a key: replays, merges, buckets, several tables under one epoch."""

import random
from pathlib import Path

import pytest

from tarnweave.operators import curation
from tarnweave.plans import dialogues
from tarnweave.streaming import duplicates, keyed

ROWS = "k string, v long, at long"


def test_replays_and_merges(spark, tmp_path):
    rng = random.Random(3)
    own = keyed.KeyedTable(str(tmp_path / "t"), ("k",), "at", buckets=3, merge_every=2)
    with pytest.raises(ValueError, match="nothing was written"):
        own.read(spark)
    want, batches = {}, []
    for epoch in range(5):
        rows = [(rng.choice("abcdefg"), 10 * epoch + i, i) for i in range(rng.randrange(6))] if epoch != 2 else []
        batches.append(rows)
        for again in (epoch, rng.randrange(epoch + 1)):  # each batch, and one of before once more
            own.write(spark.createDataFrame(batches[again], ROWS), again)
        want |= {k: (v, at) for k, v, at in rows}
        if want:
            assert {r["k"]: (r["v"], r["at"]) for r in own.read(spark).collect()} == want
    deltas = [p.name for p in (tmp_path / "t" / "delta").iterdir() if p.name.startswith("epoch=")]
    assert len(deltas) < 5 and len(list((tmp_path / "t" / "manifest").iterdir())) <= 2
    few = spark.createDataFrame([("a",), ("zz",)], "k string")
    assert {r["k"] for r in own.read(spark, few).collect()} == {"a"} & set(want)


def test_untouched_buckets_stay(spark, tmp_path):
    own = keyed.KeyedTable(str(tmp_path / "t"), ("k",), buckets=8, merge_every=1)
    own.write(spark.createDataFrame([(x, 1, 0) for x in "abcdefgh"], ROWS), 0)
    before = {b: f for b, f, _ in own.manifest(spark)}
    own.write(spark.createDataFrame([("a", 2, 0)], ROWS), 1)
    after = {b: f for b, f, _ in own.manifest(spark)}
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    assert all(Path(f).is_dir() for f in after.values())
    assert {r["k"]: r["v"] for r in own.read(spark).collect()} == {x: 2 if x == "a" else 1 for x in "abcdefgh"}
    with pytest.raises(ValueError, match="own columns"):
        own.write(spark.createDataFrame([("a", 1)], "k string, epoch int"), 2)


def test_a_batch_counts_for_all_tables_or_none(spark, tmp_path):
    commits = str(tmp_path / "commits")
    one, two = (keyed.KeyedTable(str(tmp_path / n), ("k",), commits=commits, buckets=2) for n in "ab")
    broken = [False]

    def step(b):
        if broken[0]:
            raise RuntimeError("lost")
        return b

    take = keyed.joint_sink({"one": (one, lambda b: b), "two": (two, step)})
    take(spark.createDataFrame([("x", 1, 0)], ROWS), 0)
    broken[0] = True
    with pytest.raises(RuntimeError):
        take(spark.createDataFrame([("x", 2, 0)], ROWS), 1)
    values = lambda: [t.read(spark).first()["v"] for t in (one, two)]
    assert values() == [1, 1]
    broken[0] = False
    take(spark.createDataFrame([("x", 2, 0)], ROWS), 1)
    assert values() == [2, 2]


@pytest.mark.parametrize("cuts", [(0, 40), (0, 7, 8, 23, 40)])
def test_duplicates_in_any_split(spark, tmp_path, cuts):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(9)) for _ in range(40)) for _ in range(6)]
    said = [rng.choice([b, b.upper(), b + "!", b.replace("alpha1", "alpha2", 1), b[:-1]]) for b in (rng.choice(base) for _ in range(40))]
    recs = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(said)], "conv_id long, messages array<struct<role string, content string>>")
    whole = {(r["conv_id"], r["duplicate_of"], r["method"]) for r in curation.duplicates(curation.with_hashes(recs)).collect()}
    take = duplicates.duplicates_sink(str(tmp_path / "d"))
    for epoch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        take(recs.where(f"conv_id >= {a} and conv_id < {b}"), epoch)
        if epoch == 2:
            take(recs.where(f"conv_id >= {a} and conv_id < {b}"), epoch)  # once more
    kept, told = duplicates.tables(str(tmp_path / "d"))
    assert {(r["conv_id"], r["duplicate_of"], r["method"]) for r in told.read(spark).collect()} == whole and len(whole) > 20
    assert kept.read(spark).count() == 40 - len(whole)


def test_hashed_records_in_batches(spark, tmp_path):
    """The sink takes records that were hashed ahead, without their messages, against what was kept within and beyond ``remember``."""
    words = ["alpha beta gamma", "one two three", "alpha beta gamma!", "four five six", "One two three", "alpha beta gamma"]
    recs = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(words)], "conv_id long, messages array<struct<role string, content string>>")
    hashed = curation.with_hashes(recs).drop("messages")
    for remember, want in ((None, {2: 0, 4: 1, 5: 0}), (1, {2: 0})):  # 2 isn't kept, so 5 repeats nothing of the batch before it
        take = duplicates.duplicates_sink(str(tmp_path / f"d{remember}"), remember=remember)
        for epoch, (a, b) in enumerate(((0, 2), (2, 4), (4, 6))):
            take(hashed.where(f"conv_id >= {a} and conv_id < {b}"), epoch)
        got = {r["conv_id"]: r["duplicate_of"] for r in duplicates.tables(str(tmp_path / f"d{remember}"))[1].read(spark).collect()}
        assert got == want


def test_stream_hashes_documents_once(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(curation, "with_hashes", lambda df, f=curation.with_hashes: calls.append(1) or f(df))
    rows = [(i, t) for i, t in enumerate(["a b c", None, "A b, c", "d e f", "", "d e f"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in dialogues.stream_duplicates(spark, str(tmp_path)).select("conv_id", "duplicate_of", "method").collect()}
    assert len(calls) == 1
    assert got == {tuple(r) for r in dialogues.conv_duplicates(spark, str(tmp_path)).collect()} and len(got) == 3
