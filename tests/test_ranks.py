"""Order statistics against sorting."""

import random

from tarnweave.operators import ranks, review


def test_values_at_places_of_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 4)
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.paretovariate(0.3), -1e300, 1e308, -1e308, 0.0, 7.0, 1e-310])) for g in ("a", "b", None) for _ in range(60)]
    rows += [("one", 3.0), ("a", None), ("a", float("nan")), ("b", float("inf")), ("same", 2.0), ("same", 2.0)]
    places = [(g, f"p{k}", k) for g in ("a", "b", None, "one", "same", "none") for k in (0, 1, 17, 59, 60, -1)]
    got = {(r["g"], r["name"]): r["value"] for r in ranks.values_at(spark.createDataFrame(rows, "g string, v double"), "v", spark.createDataFrame(places, "g string, name string, place long"), ["g"]).collect()}
    want = {}
    for g, name, k in places:
        values = sorted(v for x, v in rows if x == g and v is not None and abs(v) < float("inf"))
        if 0 <= k < len(values):
            want[g, name] = values[k]
    assert got == want


def test_lengths(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 1, 9, 3, 3, 3, 8, None]], "char_count long")
    assert review.char_stats(rows).first().asDict() == {"mean": 4.57, "median": 3.0, "p95": 8}
    assert review.char_stats(rows.limit(0)).first().asDict() == {"mean": None, "median": None, "p95": None}
