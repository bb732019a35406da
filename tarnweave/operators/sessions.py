"""Session state in batch form: messages, conversations, memory, limits, jobs, budgets.

Keys may be hot (a session with a third of all rows): what needs only aggregates
is pre-aggregated, what needs order uses windows whose rows Spark spills.

Defined cases: null keys are a key; ties of time go to the smaller id; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions import text


def with_sequence(rows: DataFrame, key: str, order: Sequence[str], name: str = "sequence") -> DataFrame:
    """``rows`` numbered from 1 within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def recent(rows: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key; tasks cut their rows to n before the shuffle."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def keyset_page(rows: DataFrame, order: str, limit: int, before: Column | None = None, id_col: str | None = None, search: str | None = None, title: str = "title", owner: tuple[str, str] | None = None, archived: str | None = None) -> DataFrame:
    """The newest rows before a cursor, one more than ``limit`` to tell whether there is a next page."""
    if owner:
        rows = rows.where(F.col(owner[0]) == owner[1])
    if archived:
        rows = rows.where(~F.coalesce(F.col(archived), F.lit(False)))
    if search:
        hit = F.contains(F.lower(title), F.lit(search.lower()))
        rows = rows.where(hit | (F.col(id_col).cast("string") == search) if id_col else hit)
    if before is not None:
        rows = rows.where(F.col(order) < before)
    return rows.orderBy(F.desc(order), *([id_col] if id_col else [])).limit(limit + 1)


def conversation_summary(parents: DataFrame, messages: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """``parents`` with message_count, last_message_at and the latest content; those without messages have 0 and nulls."""
    own = messages.groupBy(key).agg(F.count("*").alias("message_count"), F.max(order).alias("last_message_at"), F.max_by(content, order).alias("latest_message"))
    return parents.join(own, key, "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def empty_parents(parents: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Parents without any message."""
    return parents.join(messages.select(key), key, "left_anti")


def missing_parents(children: Sequence[DataFrame], parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys of several tables that have no parent row yet."""
    return reduce(lambda a, b: a.union(b), (c.select(key) for c in children)).distinct().join(parents.select(key), key, "left_anti")


def delete_key(rows: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number deleted)."""
    deleted = rows.join(gone.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted"))
    return rows.join(gone.select(key).distinct(), key, "left_anti"), deleted


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def single_user_message(rows: DataFrame, key: str, role: str = "role") -> DataFrame:
    """Keys with exactly one user message."""
    return rows.groupBy(key).agg(F.count_if(F.col(role) == "user").alias("n")).where("n = 1").select(key)


def fallback_title(c: Column, rules: Mapping[str, Sequence[str]], limit: int = 12, default: str = "新的对话") -> Column:
    """The title of the first rule with a term, else the first characters."""
    hit = F.get(text.matching_labels(c, rules), F.lit(0))
    return F.coalesce(hit, F.when(text.is_blank(c), default).otherwise(F.substring(text.collapse_space(c), 1, limit)))


def within_budget(rows: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """The newest rows of each key whose tokens together stay within the budget."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_t", F.sum(tokens).over(w)).where(F.col("_t") <= budget).drop("_t")


def rate_limited(events: DataFrame, key: Sequence[str], ts: str, limit: int, unit: str = "minute", tie: str | None = None) -> DataFrame:
    """``events`` with allowed, remaining and reset_seconds: the first ``limit`` of each key and clock unit are allowed."""
    size = {"minute": 60, "day": 86_400}[unit]
    start = F.date_trunc(unit, ts)
    w = Window.partitionBy(*key, start).orderBy(ts, *([tie] if tie else []))
    n = F.row_number().over(w)
    rows = events.withColumn("_n", n)
    return rows.withColumns({"allowed": F.col("_n") <= limit, "remaining": F.greatest(F.lit(0), limit - F.col("_n")), "reset_seconds": (size - F.unix_timestamp(F.col(ts).cast("timestamp")) % size).cast("int")}).drop("_n")


def expired(rows: DataFrame, column: str, now: Column | None = None) -> DataFrame:
    return rows.where(F.col(column) <= (F.current_timestamp() if now is None else now))


def merge_memory(items: DataFrame, key: Sequence[str] = ("session_id", "key"), order: str = "updated_at") -> DataFrame:
    """One row a key: the last value (lists are joined, each value once in order of coming), the best confidence, whether ever confirmed."""
    is_list = items.schema["value"].dataType.typeName() == "array"
    value = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]))) if is_list else F.max_by("value", order)
    return items.groupBy(*key).agg(value.alias("value"), F.max("confidence").alias("confidence"), F.bool_or("confirmed").alias("confirmed"), F.max(order).alias(order))


def snapshot(items: DataFrame, owner: str = "session_id") -> DataFrame:
    """(owner, memory): a map from key to value."""
    return items.groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("memory"))


def merge_maps(over: Column, under: Column, lists: Sequence[str] = ()) -> Column:
    """Both maps of arrays, ``over`` first; keys of ``lists`` keep the values of both."""
    empty = F.create_map().cast("map<string,array<string>>")
    joined = lambda k, a, b: F.when(k.isin(*lists) if lists else F.lit(False), F.array_distinct(F.concat(F.coalesce(b, F.array().cast("array<string>")), F.coalesce(a, F.array().cast("array<string>"))))).otherwise(F.coalesce(a, b))
    return F.map_zip_with(F.coalesce(over, empty), F.coalesce(under, empty), joined)


def rolling_summary(rows: DataFrame, key: str, order: str, content: str, lists: Mapping[str, tuple[Column, int]], topics: Mapping[str, Sequence[str]], window: int = 200) -> DataFrame:
    """A row per key over its last ``window`` rows: the last n contents of each list whose condition holds, and the topics."""
    own = recent(rows, key, [order], window)
    cut = lambda cond, n: F.transform(F.reverse(F.slice(F.reverse(F.array_sort(F.collect_list(F.when(cond, F.struct(order, F.col(content).alias("c")))))), 1, n)), lambda x: x["c"])
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list(text.matching_labels(F.col(content), topics)))))
    return own.groupBy(key).agg(F.count("*").alias("n_messages"), *(cut(c, n).alias(name) for name, (c, n) in lists.items()), found.alias("topics"))


def summary_due(counts: DataFrame, least: int = 16, fresh: int = 4) -> DataFrame:
    """Keys whose summary is to be made again: enough messages, and enough new ones."""
    return counts.where((F.col("n_messages") >= least) & (F.col("n_messages") - F.coalesce("summarised", F.lit(0)) >= fresh))


def facts(message: Column, dislike: str, helpful: str, topics: Mapping[str, Sequence[str]]) -> Column:
    """An array of struct(key, value, confidence): what a message says of its writer, by two patterns with one group, and topics."""
    of = lambda key, pattern, sure: F.transform(F.regexp_extract_all(text.text_or_empty(message), F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(key).alias("key"), text.strip(v).alias("value"), F.lit(sure).alias("confidence")))
    about = F.transform(text.matching_labels(message, topics), lambda t: F.struct(F.lit("topic").alias("key"), t.alias("value"), F.lit(0.7).alias("confidence")))
    return F.filter(F.concat(of("disliked", dislike, 0.9), of("helpful", helpful, 0.85), about), lambda f: f["value"] != "")


TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("queued", "validating", "processing")


def job_states(events: DataFrame, key: str = "job_id", order: str = "ts", tie: str = "event_id") -> DataFrame:
    """(job, status, progress, updated_at): the last status, but nothing follows the first cancellation; progress within 0 and 100."""
    cancelled = F.min(F.when(F.col("status") == "cancelled", F.struct(order, tie))).over(Window.partitionBy(key))
    live = events.withColumn("_c", cancelled).where(F.col("_c").isNull() | (F.struct(order, tie) <= F.col("_c")))
    last = live.groupBy(key).agg(F.max_by(F.struct("status", "progress"), F.struct(order, tie)).alias("s"), F.max(order).alias("updated_at"))
    return last.select(key, "s.status", F.greatest(F.lit(0), F.least(F.lit(100), F.col("s.progress"))).alias("progress"), "updated_at")


def recover(states: DataFrame) -> DataFrame:
    """Jobs in flight when their worker went are failed."""
    flying = F.col("status").isin("validating", "processing")
    return states.withColumn("status", F.when(flying, "failed").otherwise(F.col("status")))


def next_job(jobs: DataFrame, order: str = "created_at") -> DataFrame:
    """The oldest queued job."""
    return jobs.where("status = 'queued'").agg(F.min_by("job_id", F.struct(order, "job_id")).alias("job_id"))


def admissions(requests: DataFrame, active: DataFrame, cap: int, key: str = "session_id", order: str = "ts", hours: int = 24) -> DataFrame:
    """``requests`` with admitted and expires_at: a session's requests come in as long as it has fewer than ``cap`` active jobs."""
    busy = active.where(F.col("status").isin(*ACTIVE)).groupBy(key).agg(F.count("*").alias("_busy"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = requests.withColumn("_n", place).join(busy, key, "left")
    return rows.withColumns({"admitted": F.col("_n") + F.coalesce("_busy", F.lit(0)) <= cap, "expires_at": F.col(order) + F.expr(f"INTERVAL {int(hours)} HOURS")}).drop("_n", "_busy")


def lifecycle(events: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row a key: the latest value of each column that isn't null."""
    return events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns), F.max(order).alias(order))


def client_key(peer: Column, forwarded: Column, trusted: Sequence[str]) -> Column:
    """The client's address: the first forwarded one if the peer is a trusted proxy."""
    first = text.strip(F.substring_index(text.text_or_empty(forwarded), ",", 1))
    return F.when(peer.isin(*trusted) & (first != ""), first).otherwise(F.coalesce(peer, F.lit("unknown")))


def path_bucket(path: Column, prefixes: Mapping[str, str], default: str = "api") -> Column:
    return reduce(lambda chain, kv: chain.when(path.startswith(kv[0]), kv[1]), prefixes.items(), F).otherwise(default)


def visible(allowed: Column, c: Column, hidden: Column | str | None = None) -> Column:
    """A column as one without the right sees it."""
    return F.when(allowed, c).otherwise(F.lit(hidden) if isinstance(hidden, str) else hidden if hidden is not None else F.lit(None))


def recommend(people: DataFrame, library: DataFrame, top: int = 3) -> DataFrame:
    """The first ``top`` library entries for each person's emotion, without what they dislike; preferred kinds first.

    ``people``: (person, emotion, disliked, preferred); ``library``: (place, emotion, kind, title).
    """
    rows = people.join(library, "emotion").where(~F.exists("disliked", lambda d: F.contains(F.col("title"), d) | (F.col("kind") == d)))
    rows = rows.withColumn("preference_match", F.array_contains("preferred", F.col("kind")))
    w = Window.partitionBy("person").orderBy(F.desc("preference_match"), "place")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("person", "rank", "kind", "title", "preference_match")


def evidence_rows(df: DataFrame, sources: Mapping[str, Column], keep: Sequence[str], limit: int = 180) -> DataFrame:
    """A row for each source of a message that says something."""
    items = F.array(*(F.struct(F.lit(n).alias("source"), F.substring(text.strip(c), 1, limit).alias("content")) for n, c in sources.items()))
    return df.select(*keep, F.explode(F.filter(items, lambda e: e["content"] != "")).alias("e")).select(*keep, "e.*")


def max_sequence(parents: DataFrame, messages: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """(key, last): the highest number of each parent, 0 without messages."""
    return parents.select(key).join(messages.groupBy(key).agg(F.max(sequence).alias("last")), key, "left").select(key, F.coalesce("last", F.lit(0)).alias("last"))


def active_counts(jobs: DataFrame, key: str = "session_id") -> DataFrame:
    return jobs.groupBy(key).agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def valid_feedback(rows: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose values lie in their ranges; nulls are allowed."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isNull() | F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()), F.lit(True)))


def session_report(rows: DataFrame, key: str, means: Sequence[str], item: str, top: int = 5) -> DataFrame:
    """A row per key: means with two digits, and the most frequent items."""
    counts = rows.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), item)
    best = counts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", item))), lambda x: x[item]).alias("top"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 2).alias(c) for c in means)).join(best, key, "left")


def own_recent(feedback: DataFrame, conversations: DataFrame, owner: str, key: str = "session_id", order: Sequence[str] = ("created_at",), most: int = 20) -> DataFrame:
    """(owner, rank, feedback columns): of each owner the latest ``most`` feedback rows on their own conversations."""
    rows = feedback.join(conversations.select(key, owner).distinct(), key)
    w = Window.partitionBy(owner).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def latest_rows(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The latest ``most`` rows of a log, newest first: runs, cases or metrics of a report."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most)


def latest_run_cases(runs: DataFrame, cases: DataFrame, order: Sequence[str], case_order: str, run: str = "run_id", most: int = 100) -> DataFrame:
    """The first ``most`` cases of the latest run."""
    newest = runs.agg(F.max_by(run, F.struct(*order)).alias(run))
    return cases.join(F.broadcast(newest), run, "left_semi").orderBy(case_order).limit(most)  # one row
