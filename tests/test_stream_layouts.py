"""Streams over events in any order and in several files, as Spark writes a table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnweave.plans import measures

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the tables")


def test_limiter_in_any_order(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).sortWithinPartitions(F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in measures.stream_limiter(spark, str(tmp_path)).select("event_id", "n", "allowed").collect()}
    rows = sorted((r["event_type"], r["ts"].replace(second=0, microsecond=0), r["ts"], r["event_id"]) for r in events.collect())
    want, before, n = set(), None, 0
    for kind, minute, _, event in rows:
        n = n + 1 if before == (kind, minute) else 1
        before = kind, minute
        want.add((event, n, n <= 2))
    assert got == want
