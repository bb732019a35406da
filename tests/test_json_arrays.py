"""JSON arrays and objects of records in files of many blocks; files that are cut off or broken."""

import json
import random

import pytest

from tarnweave.sources import json_arrays


@pytest.fixture
def blocks(spark):
    """Sets the size of a block; a record or a string may span several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield of
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def records(seed, n):
    rng = random.Random(seed)
    part = lambda: rng.choice(["x,y", 'q"uote', "back\\slash\\", "[{", "}]", "é,ü", "", "\n\t ,", ",,,,"]) * rng.randrange(5)
    return [rng.choice([{"a": i, "t": part(), "l": [1, {part(): part()}]}, [part()], part(), i, None, True, {}]) for i in range(n)]


@pytest.mark.parametrize("size", [150, 1_000_000])
def test_whatever_the_blocks(spark, tmp_path, blocks, size):
    want = records(1, 120)
    for name, indent, mark in (("a", None, ""), ("b", 1, "﻿ \n")):
        (tmp_path / f"{name}.json").write_text(mark + json.dumps(want, ensure_ascii=False, indent=indent) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({f'k,"{i}': r for i, r in enumerate(want)}, indent=2))
    blocks(size)
    got = {}
    for r in json_arrays.array_items(spark, str(tmp_path)).orderBy("file", "place").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["_raw"]))
    assert got == {"a.json": want, "b.json": want, "c.json": want}


WHOLE = {
    "cut": ('[{"a":1}, {"a":2}', ['{"a":1}', '{"a":2}']), "comma": ('[{"a":1},{"a":2},', ['{"a":1}', '{"a":2}']), "after": ('[{"a":1}] left ] [ "over', ['{"a":1}']),
    "gaps": ('[1, ,"x,y" ,null]', ["1", '"x,y"', "null"]), "none": ("[]", []), "blank": (" \n", []), "empty": ("", []),
}


@pytest.mark.parametrize("size", [12, 1_000])
def test_ends(spark, tmp_path, blocks, size):
    for name, (said, _) in WHOLE.items():
        (tmp_path / name).write_text(said)
    blocks(size)
    got = {name: [] for name in WHOLE}
    for r in json_arrays.array_items(spark, str(tmp_path)).orderBy("place").collect():
        got[r["file"].rsplit("/", 1)[1]].append(r["_raw"])
    assert got == {name: found for name, (_, found) in WHOLE.items()}


@pytest.mark.parametrize(("said", "why"), [
    ('[{"a":1}, {"a":2', "ends within a record"), ('[{"a":1}, {"a":"2', "ends within a record"), ('{"x":{"a":1}', "ends within a record"), ('{"x":{"a":1}} more', "text after its object"),
    ("abc", "no JSON array or object"), ('[{"a":1}, {a:2}]', "isn't JSON"), ("[1, tru", "isn't JSON"),
])
def test_faults(spark, tmp_path, said, why):
    (tmp_path / "f.json").write_text(said)
    with pytest.raises(Exception, match=why):
        json_arrays.array_items(spark, str(tmp_path)).collect()


def test_signs_are_those_outside_strings():
    """Places of brackets and what is open there, against one byte after the other, for both starts."""
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choice('[]{}",a') if rng.random() < 0.9 else "\\\"" for _ in range(rng.randrange(60))).encode()
        for start in (False, True):
            quotes, signs, step = json_arrays._signs(data)
            got = {int(p): (int(d), bool(o)) for p, d, o in zip(signs, step, json_arrays._open(quotes, signs, start), strict=True)}
            want, opened, at = {}, start, 0
            while at < len(data):
                c = data[at : at + 1]
                at += 1
                if c == b"\\":
                    at += 1
                elif c == b'"':
                    opened = not opened
                elif c in b"[]{}":
                    want[at - 1] = (1 if c in b"[{" else -1, opened)
            assert got == want and bool((len(quotes) + start) % 2) == opened and quotes.dtype == np.int64
