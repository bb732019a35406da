"""Limiter and job machine: the same results in any split into micro-batches, late events, timeouts, recovery."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.streaming import keyed, ordered, stateful

DAY = dt.datetime(2024, 5, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENTS = "k string, event_id long, ts timestamp"


def at(seconds: float) -> dt.datetime:
    return DAY + dt.timedelta(seconds=seconds)


class Feed:
    """Files of a stream, one a micro-batch, and a clock that ticks after them."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, root, schema
        spark.createDataFrame([], "ts timestamp").write.parquet(f"{root}/clock")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def tick(self, ts):
        self.spark.createDataFrame([(ts,)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{self.root}/clock")

    def run(self, make, mode, key=None, check="check"):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        clock = self.spark.readStream.schema("ts timestamp").parquet(f"{self.root}/clock")
        out = f"{self.root}/out"
        where = {"sink": keyed.KeyedTable(out, (key,), F.struct("at", "late"), buckets=2).write} if key else {"path": out}
        stateful.run_available(make(rows, clock), f"{self.root}/{check}", mode, large_state=True, **where)
        if not key:
            return self.spark.read.parquet(out).collect()
        try:
            return keyed.KeyedTable(out, (key,), buckets=2).read(self.spark).collect()
        except ValueError:  # all events are held
            return []


def test_limiter_in_ten_shuffled_files(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i, at(rng.randrange(1_200) + rng.choice([0, 0.25]))) for i in range(240)] + [("c", 240 + i, at(90)) for i in range(10)]
    rng.shuffle(rows)
    feed = Feed(spark, str(tmp_path), EVENTS)
    for i in range(10):
        feed.put(rows[i::10])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    make = lambda events, clock: ordered.limiter(events, "k", 5, lateness="1 hour", clock=clock)
    feed.run(make, "append")
    feed.tick(at(3_600 * 3))
    got = {(r["k"], r["event_id"], r["n"], r["allowed"], r["retry_after"], r["late"]) for r in feed.run(make, "append")}
    want, count = set(), {}
    for k, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        window = k, ts.replace(second=0, microsecond=0)
        n = count[window] = count.get(window, 0) + 1
        want.add((k, event, n, n <= 5, 0 if n <= 5 else 60 - ts.second, False))
    assert got == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_limiter_late_and_without_time(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), EVENTS)
    feed.put([("a", 1, at(10)), ("a", 2, at(20)), ("a", 3, None)])
    feed.put([("a", 4, at(15)), ("a", 5, at(30))])  # in time: a minute is allowed
    feed.put([("a", 6, at(300))])
    feed.put([("a", 7, at(12)), ("b", 8, at(12))])  # too late
    feed.put([("a", 9, at(500)), (None, 10, at(500))])
    make = lambda events, clock: ordered.limiter(events, "k", 2, lateness="1 minute", clock=clock)
    feed.run(make, "append")
    feed.tick(at(900))
    got = {r["event_id"]: (r["k"], r["n"], r["allowed"], r["late"]) for r in feed.run(make, "append")}
    late = lambda k: (k, None, None, True)
    assert got == {
        1: ("a", 1, True, False), 2: ("a", 3, False, False), 3: late("a"), 4: ("a", 2, True, False), 5: ("a", 4, False, False), 6: ("a", 1, True, False),
        7: late("a"), 8: late("b"), 9: ("a", 1, True, False), 10: ("None", 1, True, False),
    }


def test_limiter_by_day_and_without_limit(spark, tmp_path):
    rows = [("a", i, at(i * 40_000)) for i in range(6)]
    for limit, refused in ((1, {1, 2, 4}), (0, set())):
        feed = Feed(spark, str(tmp_path / str(limit)), EVENTS)
        feed.put(rows)
        make = lambda events, clock, n=limit: ordered.limiter(events, ["k"], n, width=86_400, clock=clock)
        feed.run(make, "append")
        feed.tick(at(400_000))
        assert {r["event_id"] for r in feed.run(make, "append") if not r["allowed"]} == refused


JOBS = "job_id string, seq long, status string, progress int, ts timestamp"


def jobs(events, clock, **how):
    return ordered.job_machine(events, timeout=600, keep=3_600, lateness="10 minutes", clock=clock, **how)


def states(rows):
    return {r["job_id"]: (r["status"], r["progress"], r["at"], r["late"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_jobs_in_any_order(spark, tmp_path, seed):
    rows = [
        ("done", 1, "queued", 0, at(0)), ("done", 2, "validating", 10, at(60)), ("done", 3, "processing", 500, at(120)), ("done", 4, "completed", 100, at(180)), ("done", 5, "processing", 3, at(200)),
        ("back", 6, "processing", 40, at(10)), ("back", 7, "queued", 50, at(400)), ("back", 8, "unheard-of", -7, at(500)),
        ("gone", 9, "cancelled", 0, at(50)), ("gone", 10, "completed", 100, at(50)), ("twice", 11, "validating", 20, at(30)), ("twice", 11, "validating", 20, at(30)), ("quiet", 12, "processing", None, at(5)),
    ]
    random.Random(seed).shuffle(rows)
    feed = Feed(spark, str(tmp_path), JOBS)
    for i in range(3):
        feed.put(rows[i::3])
    feed.run(jobs, "update", "job_id")
    feed.tick(at(620 + 600))  # the watermark: 620 s
    got = states(feed.run(jobs, "update", "job_id"))
    assert got == {
        "done": ("completed", 100, at(180), 0), "back": ("processing", 0, at(500), 0), "gone": ("cancelled", 0, at(50), 0), "twice": ("validating", 20, at(30), 0), "quiet": ("failed", 0, at(605), 0),
    }


def test_jobs_time_out_once_and_stay_failed(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), JOBS)
    feed.put([("a", 1, "processing", 30, at(0)), ("b", 2, "processing", 30, at(0))])
    feed.put([("b", 3, "processing", 60, at(590)), ("c", 4, "queued", 0, at(3_000))])
    feed.put([("a", 5, "processing", 90, at(3_100)), ("b", 6, "completed", 100, at(100))])  # a has failed, b's is too late
    feed.put([("c", 7, "completed", 100, at(3_200))])
    feed.run(jobs, "update", "job_id")
    feed.tick(at(3_300 + 600))
    got = states(feed.run(jobs, "update", "job_id"))
    assert got == {"a": ("failed", 30, at(600), 0), "b": ("failed", 60, at(1_190), 1), "c": ("completed", 100, at(3_200), 0)}
    # a finished job is forgotten after an hour: its id may start anew
    feed.tick(at(20_000))
    feed.run(jobs, "update", "job_id")
    feed.put([("a", 8, "queued", 0, at(20_100))])
    feed.run(jobs, "update", "job_id")
    feed.tick(at(20_800))
    got = states(feed.run(jobs, "update", "job_id"))
    assert got["a"] == ("queued", 0, at(20_100), 0) and got["c"][0] == "completed"


def test_jobs_recover_after_a_stop(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), JOBS)
    feed.put([("flying", 1, "completed", 100, at(700)), ("waiting", 2, "processing", 10, at(700)), ("new", 3, "queued", 0, at(700))])
    before = spark.createDataFrame([("flying", "processing", 50, at(200)), ("waiting", "queued", 0, at(200)), ("old", "completed", 100, at(100))], "job_id string, status string, progress int, at timestamp")
    make = lambda events, clock: jobs(events, clock, before=before)
    feed.run(make, "update", "job_id")
    feed.tick(at(720 + 600))
    got = states(feed.run(make, "update", "job_id"))
    assert got == {"waiting": ("processing", 10, at(700), 0), "new": ("queued", 0, at(700), 0)}  # flying has failed and old is done: neither changes


class Handle:
    """State of one group, with a count of the calls that go to it."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def of(self, name):
        handle = self

        class State:
            def exists(self):
                handle.calls += 1
                return name in handle.kept

            def get(self):
                handle.calls += 1
                return handle.kept[name]

            def update(self, value):
                handle.calls += 1
                handle.kept[name] = value

            put = update

            def appendValue(self, value):
                handle.calls += 1
                handle.kept.setdefault(name, []).append(value)

            def clear(self):
                handle.calls += 1
                handle.kept.pop(name, None)

        return State()

    def getListState(self, name, _):
        return self.of(name)

    def getValueState(self, name, _):
        return self.of(name)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Mark:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1_000


def test_limiter_calls_state_by_blocks(spark):
    """3,000 rows of 1,000 keys, decided in two steps: calls to state don't grow with rows, keys or windows."""
    import pandas as pd

    seconds = [i % 3 * 50 for i in range(3_000)]  # 0 and 50 share a minute
    rows = pd.DataFrame({"k": [f"k{i // 3}" for i in range(3_000)], "us": [s * 10**6 for s in seconds], "known": True, "event": range(3_000)})
    limiter, handle = ordered._Limiter(["k", "event_id", "start", "n", "allowed", "retry_after", "late"], 1, 60), Handle()
    limiter.init(handle)
    assert list(limiter.handleInputRows((0,), iter([rows]), Mark(-1))) == []
    got = {}
    for mark in (20, 70, 170):
        for frame in limiter.handleExpiredTimer((0,), Mark(mark), None):
            got |= {r.event_id: (r.k, r.start, r.n, r.allowed, r.retry_after) for r in frame.itertuples()}
    assert got == {i: (f"k{i // 3}", *((0, 1, True, 0), (0, 2, False, 10), (60, 1, True, 0))[i % 3]) for i in range(3_000)}
    assert handle.calls < 40 and not handle.kept
