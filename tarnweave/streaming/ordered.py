"""Streams whose results don't depend on how events are split into micro-batches.

A key's events are held in state until the watermark has passed them and are
then applied once, in order of time. What comes later than the watermark allows
can't be put in order any more; it isn't lost but comes out as late. State is
bounded: events by the lateness, counters by their windows, jobs by timers.

An event is late if it lies at or before the watermark of its micro-batch, which
is the newest event of the batches before, less the lateness. Operators here see
the time as a plain number next to the watermark, for Spark would drop late rows
unseen before they reach an operator on the watermark's own column.

A watermark moves with events only. ``clock``, a stream of (ts), moves it where a
key's last events should come out without more events, such as a rate source or
the time of the end of a backlog.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tarnweave.operators import sessions

LATENESS = "2 minutes"
#: The state store of these operators, which keeps lists and timers beside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(events: DataFrame, columns: Sequence[Column], ts: str, lateness: str, clock: DataFrame | None) -> DataFrame:
    """``columns`` and the time as ``us`` (microseconds), above a watermark; events without a time are the earliest."""
    at = F.col(ts).cast("timestamp")
    rows = events.select(*columns, at.alias("_at"), F.lit(False).alias("_tick"))
    if clock is not None:
        rows = rows.unionByName(clock.select(F.col(clock.columns[0]).cast("timestamp").alias("_at"), F.lit(True).alias("_tick")), allowMissingColumns=True)
    rows = rows.withWatermark("_at", lateness)
    # the condition names the time, or ticks would be dropped before they move the watermark
    events = rows.where("not _tick or _at is null")
    return events.select("*", F.coalesce(F.unix_micros("_at"), F.lit(-(2**62))).alias("us")).drop("_at", "_tick")


class InOrder(StatefulProcessor):
    """Holds rows (us, ...) of a key until the watermark has passed them; subclasses apply them."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{n} {k}" for n, k in zip(self.names, self.kinds, strict=True)))

    def apply(self, key: tuple, rows: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        """Output for rows in order (maybe none) when the watermark is at ``mark`` microseconds."""
        raise NotImplementedError

    def late(self, key: tuple, rows: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def wake(self, us: int) -> None:
        """Have ``apply`` called once the watermark has passed a time."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            values = [part[n].astype(object).where(part[n].notna(), None).tolist() for n in self.names]
            whole = list(zip(*values, strict=True))
            over = [r for r in whole if r[0] <= mark]
            if over:
                yield from self.late(key, over, mark)
            fresh = [r for r in whole if r[0] > mark]
            if fresh:
                self.held.appendList(fresh)
                self.wake(max(r[0] for r in fresh))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.held.get()) if self.held.exists() else []
        due = sorted((tuple(r) for r in held if r[0] <= mark), key=lambda r: [(x is not None, x) for x in r])
        if due:
            rest = [tuple(r) for r in held if r[0] > mark]
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        yield from self.apply(key, due, mark)

    def close(self) -> None:
        pass


def _frame(columns: Iterable[str], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns))


#: Limiter buckets; each holds and counts the rows of many keys and windows together.
BUCKETS = 256


class _Limiter(StatefulProcessor):
    """Counts a bucket of keys and windows; what is held or counted goes to state as blocks of rows, not row by row.

    A counter depends on its own window's events only, so keys with many events are spread over
    buckets by their windows, and many keys with few events share one.
    """

    def __init__(self, columns: Sequence[str], limit: int, width: int) -> None:
        self.columns, self.limit, self.width = list(columns), limit, width
        self.keys = self.columns[:-6]
        self.rows = [*self.keys, "us", "known", "event"]

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.counts = handle.getValueState("counts", "block binary")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-int(us) // 1000))

    def _out(self, rows: pd.DataFrame, **columns: Any) -> pd.DataFrame:
        out = pd.DataFrame({k: rows[k].where(rows[k].notna(), "None") for k in self.keys}, columns=self.keys, index=rows.index)
        out[self.columns[-6]] = rows["event"].astype("Int64").where(rows["known"])
        return out.assign(**columns)[self.columns]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            over = part[part["us"] <= mark]
            if len(over):
                start = (over["us"] // 10**6 // self.width * self.width).astype("Int64").where(over["us"] >= 0)
                none = pd.array([pd.NA] * len(over), "Int64")
                yield self._out(over, start=start, n=none, allowed=pd.array(none, "boolean"), retry_after=none, late=True)
            fresh = part.loc[part["us"] > mark, self.rows]
            if len(fresh):
                self.held.appendValue((_block(fresh, self.keys),))
                self._wake(fresh["us"].min())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [_unblock(r[0]) for r in self.held.get()] if self.held.exists() else []
        held = pd.concat(blocks, ignore_index=True) if blocks else None
        due = None if held is None else held[held["us"] <= mark]
        if due is not None and len(due):
            rest = held[held["us"] > mark]
            if len(rest):
                self.held.put([(_block(rest, self.keys),)])
                self._wake(rest["us"].min())
            else:
                self.held.clear()
            yield self._decided(due, mark)
        elif self.counts.exists():
            self._count(_unblock(self.counts.get()[0]), mark)

    def _decided(self, due: pd.DataFrame, mark: int) -> pd.DataFrame:
        window = [*self.keys, "start"]
        second = due["us"] // 10**6
        rows = due.assign(second=second, start=second // self.width * self.width).sort_values(["us", "known", "event"])
        n = rows.groupby(window, sort=False, dropna=False).cumcount() + 1
        before = _unblock(self.counts.get()[0]) if self.counts.exists() else None
        if before is not None:
            rows = rows.merge(before, "left", window)  # rows stay in their order
            n = n.to_numpy() + rows["n"].fillna(0).astype("int64")
        rows["n"] = n
        last = rows[[*window, "n"]] if before is None else pd.concat([before, rows[[*window, "n"]]], ignore_index=True)
        self._count(last.groupby(window, sort=False, dropna=False, as_index=False)["n"].max(), mark)
        allowed = (rows["n"] <= self.limit) | (self.limit <= 0)
        return self._out(rows, start=rows["start"], n=rows["n"], allowed=allowed, retry_after=(self.width - rows["second"] % self.width).where(~allowed, 0), late=False)

    def _count(self, counts: pd.DataFrame, mark: int) -> None:
        """Keep the counters of windows of which rows can still come."""
        kept = counts[(counts["start"] + self.width) * 10**6 > mark]
        if len(kept):
            self.counts.update((_block(kept, self.keys),))
            self._wake((kept["start"].max() + self.width) * 10**6)
        else:
            self.counts.clear()

    def close(self) -> None:
        pass


def _block(rows: pd.DataFrame, texts: Sequence[str]) -> bytes:
    """Rows as Arrow bytes; columns that aren't ``texts`` are numbers and flags without nulls."""
    kinds = {c: pa.string() if c in texts else pa.bool_() if c == "known" else pa.int64() for c in rows.columns}
    table = pa.Table.from_pandas(rows, pa.schema(kinds.items()), preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unblock(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(block)).read_pandas()


def limiter(events: DataFrame, key: str | Sequence[str], limit: int, ts: str = "ts", event: str = "event_id", width: int = 60, lateness: str = LATENESS, clock: DataFrame | None = None) -> DataFrame:
    """(key, event, start, n, allowed, retry_after, late): one decision for every event, the same in any split into batches.

    The first ``limit`` events of a key and clock window of ``width`` seconds
    (60: a minute, 86400: a day) are allowed, in order of time and then of event;
    with a limit of 0 or less all are. ``start`` is the window's first second,
    ``retry_after`` the seconds until it ends, 0 if allowed. A late event, or one
    without a time, has null for n, allowed and retry_after. Several keys are
    one bucket; null keys are the bucket "None".
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = [*keys, event, "start", "n", "allowed", "retry_after", "late"]
    number = F.col(event).cast("long")
    rows = _timed(events, [*(F.col(k).cast("string").alias(k) for k in keys), number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("event")], ts, lateness, clock)
    window = F.floor(F.col("us") / F.lit(width * 10**6))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys, window), F.lit(BUCKETS)))
    out = ", ".join([*(f"{k} string" for k in keys), f"{event} long", "start long", "n long", "allowed boolean", "retry_after long", "late boolean"])
    return rows.groupBy("bucket").transformWithStateInPandas(_Limiter(columns, limit, width), out, "append", "eventTime")


_RANK = {"queued": 0, "validating": 1, "processing": 2, "completed": 3, "failed": 3, "cancelled": 3}


class _Jobs(InOrder):
    names, kinds = ("us", "seq", "status", "progress"), ("long", "long", "string", "int")

    def __init__(self, key: str, timeout: int, keep: int) -> None:
        self.columns, self.timeout, self.keep = [key, "status", "progress", "at", "late"], timeout * 10**6, keep * 10**6

    def init(self, handle: Any) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, progress int, us long")
        self.missed = handle.getValueState("missed", "n int")

    def _row(self, key: tuple, job: tuple) -> pd.DataFrame:
        status, progress, us = job
        late = self.missed.get()[0] if self.missed.exists() else 0
        return _frame(self.columns, [(str(key[0]), status, progress, pd.Timestamp(us, unit="us", tz="UTC"), late)])

    def _store(self, job: tuple) -> None:
        self.job.update(job)
        self.wake(job[2] + (self.keep if job[0] in sessions.TERMINAL else self.timeout))

    def late(self, key: tuple, rows: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        """They change nothing but the count of late events; a job of which nothing is known has none."""
        known = self.job.exists()
        if known or self.held.exists():
            self.missed.update(((self.missed.get()[0] if self.missed.exists() else 0) + len(rows),))
        if known:
            yield self._row(key, tuple(self.job.get()))

    def apply(self, key: tuple, rows: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        before = tuple(self.job.get()) if self.job.exists() else None
        job = before
        for us, _, status, progress in rows:
            job = self._due(job, us)
            now, done, _ = job or ("queued", 0, us)
            if now in sessions.TERMINAL:
                continue
            forward = _RANK.get(status, -1) >= _RANK[now]
            job = (status if forward else now, max(0, min(100, int(progress))) if progress is not None else done, us)
        job = self._due(job, mark + 1)  # no event up to the mark can come any more
        if job is None:
            return
        if job != before:
            self._store(job)
            yield self._row(key, job)
        elif job[0] in sessions.TERMINAL and job[2] + self.keep <= mark and not self.held.exists():
            self.job.clear()
            self.missed.clear()

    def _due(self, job: tuple | None, us: int) -> tuple | None:
        """The job at a time: failed if it has been silent for longer than allowed."""
        if job is None or job[0] in sessions.TERMINAL or job[2] + self.timeout >= us:
            return job
        return ("failed", job[1], job[2] + self.timeout)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        r = initialState.iloc[0]
        self._store((r["status"], int(r["progress"]), int(r["us"])))


def job_machine(
    events: DataFrame, key: str = "job_id", ts: str = "ts", timeout: int = 3_600, keep: int = 86_400, lateness: str = LATENESS, clock: DataFrame | None = None, before: DataFrame | None = None
) -> DataFrame:
    """(job, status, progress, at, late): a job's state each time it changes, for update mode; in one batch maybe several times, the last by (at, late).

    ``events``: (job_id, seq, status, progress, ts). They apply in order of ts and
    seq, whatever order they come in: a status never goes back, an unknown one
    changes nothing, progress stays within 0 and 100 (null: as it was), and after
    completed, failed or cancelled nothing changes any more. A job fails when no event
    follows its last one within ``timeout`` seconds of event time. A finished job
    is remembered for ``keep`` seconds after its end, so that repeats and
    stragglers don't start it anew; then its state goes. ``late`` counts events
    that came too late to be put in order. Events without a time are late.

    ``before``: (job, status, progress, at) of a stream that was stopped; jobs then
    in flight have failed (``sessions.recover``), others go on from there.
    """
    rows = _timed(events, [F.col(key).cast("string").alias(key), F.col("seq").cast("long").alias("seq"), F.col("status").cast("string").alias("status"), F.col("progress").cast("int").alias("progress")], ts, lateness, clock)
    out = f"{key} string, status string, progress int, at timestamp, late int"
    start = None
    if before is not None:
        known = sessions.recover(before).select(F.col(key).cast("string").alias(key), "status", F.col("progress").cast("int").alias("progress"), F.unix_micros("at").alias("us"))
        start = known.groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(_Jobs(key, timeout, keep), out, "update", "eventTime", initialState=start)
