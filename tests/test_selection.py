"""Balanced selection against deciding one record after the other."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import selection


def in_turn(order, keys, caps, held, n):
    """The first n of ``order`` that no cap keeps out, asked one by one."""
    held, got = Counter(held), []
    for i in order:
        if len(got) < n and all(held[k] < caps.get(k, math.inf) for k in keys[i]):
            got.append(i)
            held.update(keys[i])
    return got


def by_hand(records, labels, target):
    ids = sorted(records, key=lambda i: (-records[i]["final_score"], i))
    if len(ids) <= target:
        return set(ids)
    fields = Counter(f for f, _ in set().union(*labels.values()))
    caps = {x: max(3, math.ceil(target / fields[x[0]] * 1.8)) for x in set().union(*labels.values()) if fields[x[0]] >= 3 and x[0] != "severity"}
    high = {("severity", "high"): max(1, math.ceil(target * 0.12))}
    field = "problem" if len({r["group"] for r in records.values()}) == 1 and len({r["problem"] for r in records.values()}) > 1 else "group"
    strata, keep = {}, int(target * 0.6)
    for i in ids:
        strata.setdefault(records[i][field] or "unknown", []).append(i)
    quota = {s: max(1, round(len(x) / len(ids) * keep)) for s, x in strata.items()}
    while sum(quota.values()) > keep and max(quota.values()) > 1:
        quota[max(quota, key=quota.get)] -= 1
    order = [i for s in sorted(strata, key=lambda s: (-quota[s], s)) for i in strata[s]]
    stratum_of = {i: ("stratum", s) for s, x in strata.items() for i in x}
    with_stratum = {i: labels[i] | {stratum_of[i]} for i in ids}
    got = in_turn(order, with_stratum, caps | high | {("stratum", s): q for s, q in quota.items()}, {}, keep)
    worth = lambda i, gain: gain * 1000 + records[i]["coverage_score"] * 10 + records[i]["final_score"]
    while len(got) < target:
        held = Counter(x for i in got for x in labels[i])
        free = [i for i in ids if i not in got and all(held[x] < (caps | high).get(x, math.inf) for x in labels[i])]
        if not free:
            break
        got.append(max(free, key=lambda i: (worth(i, sum(held[x] == 0 for x in labels[i])), -ids.index(i))))
    held = Counter(x for i in got for x in labels[i])
    return set(got + in_turn([i for i in ids if i not in got], labels, high, held, target - len(got)))


def tables(spark, records, labels):
    r = spark.createDataFrame([(i, x["group"], x["problem"], x["coverage_score"], x["final_score"]) for i, x in records.items()], "id long, group string, problem string, coverage_score double, final_score double")
    return r, spark.createDataFrame([(i, f, v) for i, x in labels.items() for f, v in x], "id long, field string, value string")


@pytest.mark.parametrize(("seed", "n", "target", "groups"), [(1, 160, 60, 5), (2, 120, 30, 1), (3, 90, 80, 40), (4, 40, 40, 3)])
def test_selection(spark, seed, n, target, groups):
    rng = random.Random(seed)
    records, labels = {}, {}
    for i in range(n):
        group, problem = f"g{int(rng.random() ** 3 * groups)}", f"p{rng.randrange(6)}"
        records[i] = {"group": group, "problem": problem, "coverage_score": float(rng.randrange(20)), "final_score": float(rng.randrange(100))}
        labels[i] = {("group", group), ("problem", problem), ("severity", rng.choice(["high", "low"])), ("rare", f"r{rng.randrange(25)}"), *(("strategy", f"s{rng.randrange(12)}") for _ in range(2))}
    got = [r["id"] for r in selection.balanced(*tables(spark, records, labels), target).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(records, labels, target)


@pytest.mark.parametrize("seed", range(6))
def test_quotas(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{i}": rng.randrange(1, 60) for i in range(rng.randrange(1, 9))}
    keep = rng.randrange(1, 40)
    want = {s: max(1, round(n / sum(sizes.values()) * keep)) for s, n in sizes.items()}
    while sum(want.values()) > keep and max(want.values()) > 1:
        want[max(want, key=want.get)] -= 1
    strata = spark.createDataFrame([(s, n, k) for k, (s, n) in enumerate(sizes.items())], "stratum string, n long, at long")
    assert {r["stratum"]: r["quota"] for r in selection.quotas(strata, keep).collect()} == want


def test_admission_keeps_the_order(spark):
    """A row that must wait for an earlier one isn't overtaken by a later one for the same place."""
    keys = {1: {"a", "b"}, 2: {"b"}, 3: {"b", "c"}, 4: {"c"}, 5: {"a"}, 6: set(), 7: {"c"}}
    caps = {"a": 1, "b": 1, "c": 2}
    rows = spark.createDataFrame([(i, i) for i in keys], "id long, place long")
    edges = spark.createDataFrame([(i, k) for i, x in keys.items() for k in x], "id long, key string")
    limits = spark.createDataFrame([(k, n, 0) for k, n in caps.items()], "key string, cap long, held long")
    for n in (2, 7):
        got = sorted(r["id"] for r in selection.admit(rows, edges, limits, n).collect())
        assert got == in_turn(list(keys), keys, caps, {}, n)
    full = limits.withColumn("held", F.lit(1).cast("long"))
    assert sorted(r["id"] for r in selection.admit(rows, edges, full, 7).collect()) == [4, 6]
