"""Queries of evaluation, sessions and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.operators import evaluation, retrieval, sessions
from tarnweave.session import scratch_path, settle, table
from tarnweave.streaming import keyed, ordered, stateful


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five neighbours of each query vector with their labels, and the queries' own labels."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    found = settle(retrieval.nearest(e, asked, 5), "neighbours").join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("source_id")), "doc_id")
    return found.select("query_id", "rank", "source_id"), asked.select(F.col("vec_id").alias("query_id"), F.when(F.col("label") != 0, F.col("label").cast("string")).alias("source_id"))


def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 stands for queries without a relevant source."""
    found, truth = _neighbours(spark, sf_dir)
    report = evaluation.retrieval_report(evaluation.retrieval_rows(found, truth))
    return report.select("query_count", *(F.round(c, 6).alias(c) for c in report.columns if c != "query_count"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _neighbours(spark, sf_dir)
    votes = found.groupBy("query_id", "source_id").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.max_by("source_id", F.struct("n", F.col("source_id"))).alias("predicted"))
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("expected"))
    return e.join(votes, "query_id", "left")


def eval_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.classification_report(_predicted(spark, sf_dir))
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")))


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_predicted(spark, sf_dir))


def eval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.label_report(evaluation.confusion(_predicted(spark, sf_dir)))
    return r.select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts stand for predictions of low quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 0, "high").otherwise("low").alias("expected"), F.when(F.col("n_chars") > 4000, "high").otherwise("low").alias("predicted"), (F.col("toxic") == 1).alias("negated_expected"), (F.col("n_chars") < 2000).alias("negated_predicted"), F.lit(False).alias("third_party_expected"), F.lit(True).alias("third_party_predicted"))


def eval_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with the first 100 ids of each kind, as its SQL lists them; ``eval_safety_misses`` has them all."""
    rows = _cases(spark, sf_dir)
    r, misses = evaluation.safety_report(rows), evaluation.safety_misses(rows)

    def ids(kind: str, name: str) -> DataFrame:
        first = misses.where(F.col("kind") == kind).orderBy("case_id").limit(100)
        return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list("case_id")), lambda x: x.cast("string")), ",").alias(name))

    r = r.select(*(F.round(c, 6).alias(c) for c in ("high_risk_recall", "high_risk_precision", "negation_accuracy", "third_party_accuracy")), "high_risk_false_negative_count", "high_risk_false_positive_count")
    # one row each
    return r.crossJoin(ids("missed_high_risk", "missed_high_risk_case_ids")).crossJoin(ids("false_positive", "false_positive_case_ids"))


def eval_safety_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.safety_misses(_cases(spark, sf_dir))


def eval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("total_duration_ms"), (F.col("event_type") != "error").alias("success"))
    r = evaluation.latency_report(rows, by=["event_type"])
    return r.select("event_type", "request_count", "average_latency_ms", "p50_latency_ms", "p95_latency_ms", "success_rate")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("framework_id"), (F.col("user_id") % 3).cast("string").alias("metric_name"), F.col("value").alias("score"), (F.col("event_id") % 2).alias("run"))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.score_summary(_scores(spark, sf_dir))


def eval_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return evaluation.metric_delta(evaluation.score_summary(s.where("run = 0")), evaluation.score_summary(s.where("run = 1")))


def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.lit("all").alias("method"), "quality", "toxic", F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic_of_good"))
    return evaluation.macro_means(rows, ["quality", "toxic", "toxic_of_good"])


def eval_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a table; its hashes have no counterpart in SQL, and the tests reorder and change rows."""
    return evaluation.table_digest(table(spark, sf_dir, "orders"))


# --- sessions ---------------------------------------------------------------


def sess_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "event_type")


def sess_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.with_sequence(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "sequence")


def sess_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    r = sessions.conversation_summary(parents, orders, "o_custkey", "at", "o_orderpriority")
    return r.select("o_custkey", "c_name", "message_count", F.col("last_message_at.o_orderkey").alias("last_order"), "latest_message")


def sess_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return sessions.empty_parents(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


def sess_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return sessions.keyset_page(rows, "o_orderkey", 25, F.lit(1000), owner=("o_orderstatus", "F"), search="urg", title="o_orderpriority")


def sess_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    return sessions.within_budget(rows, "conv_id", "turn", "tokens", 600).select("conv_id", "turn", "tokens")


def sess_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sessions.rate_limited(table(spark, sf_dir, "events"), ["user_id"], "ts", 2, "day", "event_id")
    return r.select("event_id", "allowed", "remaining", "reset_seconds")


def sess_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("value").alias("confidence"), (F.col("event_id") % 7 == 0).alias("confirmed"), F.struct("ts", "event_id").alias("updated_at"))
    return sessions.merge_memory(items).select("session_id", "key", "value", F.round("confidence", 6).alias("confidence"), "confirmed")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "click", "validating").when(kind == "view", "processing").when(kind == "purchase", "completed").otherwise("cancelled")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), F.floor(F.col("value")).cast("int").alias("progress"))


def sess_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.job_states(_jobs(spark, sf_dir)).select("job_id", "status", "progress")


def sess_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(kind == "signup", F.col("event_id")).alias("signup"), F.when(kind == "purchase", F.col("event_id")).alias("purchase"))
    return sessions.lifecycle(rows, "user_id", "at", ["signup", "purchase"]).select("user_id", "signup", "purchase")


def sess_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit("old").alias("state"))
    return sessions.upsert(c, c.where("c_nationkey < 5").withColumn("state", F.lit("new")), "c_custkey").groupBy("state").agg(F.count("*").alias("n"))


def sess_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    r = sessions.rolling_summary(rows, "conv_id", "turn", "text", {"users": (F.col("role") == "user", 2), "assistants": (F.col("role") == "assistant", 1)}, {"english": ("the ",), "french": ("dans ",)})
    return r.select("conv_id", "n_messages", F.size("users").alias("n_users"), F.sha2(F.array_join("users", "\n"), 256).alias("users"), F.sha2(F.array_join("assistants", "\n"), 256).alias("assistants"), F.array_join("topics", ",").alias("topics"))


# --- streams ----------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # by the folder's listing, so that the table may be one file or, as Spark writes it, a folder of files
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir.rstrip('/')}/[e]vents.parquet")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type and hour, kept by an idempotent sink in update mode."""
    out = scratch_path(spark, "tumbling")
    counts = stateful.tumbling_counts(_stream(spark, sf_dir), ["event_type"], width="1 hour")
    kept = keyed.KeyedTable(out, ("event_type", "start"))
    stateful.run_available(counts, f"{out}-check", "update", keyed.keyed_sink(kept))
    return kept.read(spark)


def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user by a stateful aggregate in update mode."""
    out = scratch_path(spark, "memory")
    rows = _stream(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    kept = keyed.KeyedTable(out, ("user_id",))
    stateful.run_available(stateful.last_by_key(rows, ["user_id"], "at"), f"{out}-check", "update", keyed.keyed_sink(kept))
    return kept.read(spark).select("user_id", "event_id", "event_type")


def _clock(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A stream of one tick, a second and the lateness after the last event, that comes when ``_tick`` has written it."""
    return spark.readStream.schema("ts timestamp").parquet(f"{path}-clock")


def _tick(spark: SparkSession, sf_dir: str, path: str) -> None:
    end = F.date_trunc("second", F.max("ts")) + F.expr(f"INTERVAL 1 SECOND + INTERVAL {ordered.LATENESS}")
    table(spark, sf_dir, "events").agg(end.cast("timestamp").alias("ts")).where("ts is not null").write.mode("append").parquet(f"{path}-clock")


def _through(spark: SparkSession, sf_dir: str, name: str, make: Callable[[DataFrame, DataFrame], DataFrame], mode: str, key: str | None = None) -> str:
    """The folder of what a stream makes of all events: first of these, then, by the clock, of the last ones."""
    out = scratch_path(spark, name)
    spark.createDataFrame([], "ts timestamp").write.parquet(f"{out}-clock")
    for last in (False, True):
        if last:
            _tick(spark, sf_dir, out)
        rows = make(_stream(spark, sf_dir), _clock(spark, sf_dir, out))
        where = {"sink": keyed.keyed_sink(keyed.KeyedTable(out, (key,), F.struct("at", "late")))} if key else {"path": out}
        stateful.run_available(rows, f"{out}-check", mode, large_state=True, **where)
    return out


def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every event: two a minute and type."""
    out = _through(spark, sf_dir, "limiter", lambda rows, clock: ordered.limiter(rows, "event_type", 2, clock=clock), "append")
    return spark.read.parquet(out).select("event_type", "event_id", "n", "allowed")


def stream_limiter_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every event: two a day, user and type."""
    out = _through(spark, sf_dir, "limiter-daily", lambda rows, clock: ordered.limiter(rows, ["user_id", "event_type"], 2, width=86_400, clock=clock), "append")
    return spark.read.parquet(out).select("event_id", F.col("user_id").cast("long").alias("user_id"), "n", "allowed", "retry_after", "late")


def stream_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in four batches, one of them twice: the last order of each customer and the count of each status under one epoch."""
    out = scratch_path(spark, "keyed")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    own = lambda name, key, order: keyed.KeyedTable(f"{out}/{name}", key, order, buckets=4, merge_every=2, commits=f"{out}/commits")
    last, seen = own("last", ("o_custkey",), "o_orderkey"), own("seen", ("o_orderstatus", "part"), None)
    step = lambda b: b.groupBy("o_orderstatus", (F.col("o_orderkey") % 4).alias("part")).agg(F.count("*").alias("n"))
    take = keyed.joint_sink({"last": (last, lambda b: b), "seen": (seen, step)})
    for epoch in (0, 1, 2, 1, 3):
        take(rows.where(F.col("o_orderkey") % 4 == epoch), epoch)
    counts = seen.read(spark).groupBy("o_orderstatus").agg(F.sum("n").alias("of_status"))
    return last.read(spark).join(counts, "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus", "of_status")


def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user and type while the watermark holds the key."""
    out = scratch_path(spark, "first")
    rows = stateful.first_by_key(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], lateness="60 days")
    stateful.run_available(rows.select("user_id", "event_type"), f"{out}-check", path=out)
    return spark.read.parquet(out)


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs whose events move them on; half a day of silence is a failure."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "click", "validating").when(kind == "view", "processing").when(kind == "purchase", "completed").otherwise("cancelled")
    jobs = lambda rows: rows.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 != 0, "validating").otherwise(status).alias("status"), F.floor("value").alias("progress"), "ts")
    out = _through(spark, sf_dir, "jobs", lambda rows, clock: ordered.job_machine(jobs(rows), timeout=43_200, keep=5_000_000, clock=clock), "update", "job_id")
    return keyed.KeyedTable(out, ("job_id",)).read(spark).select(F.col("job_id").cast("long").alias("job_id"), "status", "progress", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_retrieval, eval_classification, eval_confusion, eval_labels, eval_safety, eval_safety_misses, eval_latency, eval_scores, eval_delta, eval_macro, eval_digest, sess_recent, sess_sequence, sess_summary, sess_empty, sess_page,
        sess_budget, sess_limits, sess_memory, sess_jobs, sess_lifecycle, sess_upsert, sess_rolling, stream_tumbling, stream_memory, stream_limiter, stream_limiter_daily, stream_keyed, stream_first, stream_jobs,
    )
}

_N = """
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, label AS ql, v AS qv FROM e WHERE vec_id % 100 = 0),
    dot AS (SELECT query_id, ql, vec_id, CAST(label AS VARCHAR) AS source_id, round(list_inner_product(qv, v), 6) AS score FROM q, e WHERE vec_id <> query_id AND list_inner_product(qv, v) > 0),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dot) WHERE rank <= 5)
"""
_PRED = _N + """,
    vote AS (SELECT query_id, source_id, count(*) AS n FROM nb GROUP BY ALL), top AS (SELECT query_id, source_id AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, source_id DESC) AS r FROM vote) WHERE r = 1),
    pr AS (SELECT CAST(ql AS VARCHAR) AS expected, coalesce(predicted, 'none') AS predicted FROM q LEFT JOIN top USING (query_id)),
    conf AS (SELECT expected, predicted, count(*) AS n FROM pr GROUP BY ALL),
    lab AS (SELECT label, coalesce((SELECT sum(n) FROM conf WHERE expected = label AND predicted = label), 0) AS tp, coalesce((SELECT sum(n) FROM conf WHERE expected = label), 0) AS support, coalesce((SELECT sum(n) FROM conf WHERE predicted = label), 0) AS said FROM (SELECT expected AS label FROM conf UNION SELECT predicted FROM conf)),
    rep AS (SELECT label, support, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM lab),
    f1 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rep)
"""
_at = lambda k: f"max(CASE WHEN rank <= {k} AND source_id = CAST(ql AS VARCHAR) THEN 1 ELSE 0 END)"
_JOB = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'validating' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END"

ORACLE = {
    "eval_retrieval": f"""WITH {_N}, g AS (SELECT query_id, ql, min(rank) FILTER (source_id = CAST(ql AS VARCHAR)) AS first, count(rank) AS n FROM q LEFT JOIN nb USING (query_id, ql) GROUP BY ALL),
        w AS (SELECT *, CASE WHEN ql <> 0 AND first IS NOT NULL THEN 1 ELSE 0 END AS hit FROM g), t AS (SELECT count(*) AS a, count(*) FILTER (ql <> 0) AS s, count(*) FILTER (ql = 0) AS z FROM w)
        SELECT any_value(a) AS query_count, {", ".join(f"round(sum(CASE WHEN hit = 1 AND first <= {k} THEN 1 ELSE 0 END) / any_value(s), 6) AS recall_{k}, round(sum(CASE WHEN hit = 1 AND first <= {k} THEN 1.0::DOUBLE / greatest(1, least(n, {k})) ELSE 0 END) / any_value(a), 6) AS precision_{k}, round(sum(CASE WHEN hit = 1 AND first <= {k} THEN 1 / log2(first + 1) ELSE 0 END) / any_value(s), 6) AS ndcg_{k}" for k in (1, 3, 5))},
               round(sum(CASE WHEN hit = 1 THEN 1.0::DOUBLE / first ELSE 0 END) / any_value(s), 6) AS mrr, round(sum(hit) / any_value(s), 6) AS source_citation_accuracy,
               round(CASE WHEN any_value(z) > 0 THEN count(*) FILTER (ql = 0 AND n > 0) / any_value(z) ELSE 0 END, 6) AS irrelevant_retrieval_rate, round(CASE WHEN any_value(z) > 0 THEN count(*) FILTER (ql = 0 AND n = 0) / any_value(z) ELSE 0 END, 6) AS correct_rejection_rate FROM w, t""",
    "eval_classification": f"WITH {_PRED} SELECT (SELECT CAST(sum(n) AS BIGINT) FROM conf) AS n, round((SELECT coalesce(sum(n), 0) FROM conf WHERE expected = predicted) / (SELECT sum(n) FROM conf), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1 FROM f1",
    "eval_confusion": f"WITH {_PRED} SELECT * FROM conf",
    "eval_labels": f"WITH {_PRED} SELECT label, CAST(support AS BIGINT) AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM f1",
    "eval_safety": """WITH r AS (SELECT doc_id, quality = 0 AS e, n_chars > 4000 AS p, toxic = 1 AS ne, n_chars < 2000 AS np FROM labels JOIN documents USING (doc_id))
        SELECT round(count(*) FILTER (e AND p) / count(*) FILTER (e), 6) AS high_risk_recall, round(count(*) FILTER (e AND p) / count(*) FILTER (p), 6) AS high_risk_precision, round(count(*) FILTER (ne AND np) / count(*) FILTER (ne), 6) AS negation_accuracy, 0.0 AS third_party_accuracy,
               count(*) FILTER (e AND NOT p) AS high_risk_false_negative_count, count(*) FILTER (NOT e AND p) AS high_risk_false_positive_count,
               array_to_string(list_slice(list_sort(list(doc_id) FILTER (e AND NOT p)), 1, 100), ',') AS missed_high_risk_case_ids, array_to_string(list_slice(list_sort(list(doc_id) FILTER (NOT e AND p)), 1, 100), ',') AS false_positive_case_ids FROM r""",
    "eval_safety_misses": """WITH r AS (SELECT doc_id, coalesce(quality = 0, false) AS e, coalesce(n_chars > 4000, false) AS p FROM labels JOIN documents USING (doc_id))
        SELECT doc_id AS case_id, CASE WHEN e THEN 'missed_high_risk' ELSE 'false_positive' END AS kind FROM r WHERE e <> p""",
    "eval_latency": """WITH r AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS ms FROM events) SELECT event_type, count(*) AS request_count, round(avg(ms), 2) AS average_latency_ms, CAST(floor(median(ms)) AS BIGINT) AS p50_latency_ms,
        list_sort(list(ms))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1] AS p95_latency_ms, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS success_rate FROM r GROUP BY event_type""",
    "eval_scores": "SELECT event_type AS framework_id, CAST(user_id % 3 AS VARCHAR) AS metric_name, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_pop(value), 3) AS std, count(value) AS n FROM events GROUP BY 1, 2",
    "eval_delta": """WITH m AS (SELECT event_type AS framework_id, CAST(user_id % 3 AS VARCHAR) AS metric_name, event_id % 2 AS run, round(avg(value), 3) AS mean FROM events GROUP BY ALL)
        SELECT a.framework_id, a.metric_name, a.mean AS candidate_mean, b.mean AS baseline_mean, round(a.mean - b.mean, 3) AS delta FROM m a JOIN m b USING (framework_id, metric_name) WHERE a.run = 0 AND b.run = 1""",
    "eval_macro": "SELECT 'all' AS method, unnest(['quality', 'toxic', 'toxic_of_good']) AS metric, unnest([round(avg(quality), 4), round(avg(toxic), 4), round(avg(toxic) FILTER (quality = 1), 4)]) AS value FROM labels",
    "sess_recent": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3",
    "sess_sequence": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders",
    "sess_summary": """SELECT c_custkey AS o_custkey, c_name, count(o_orderkey) AS message_count, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS latest_message
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""",
    "sess_empty": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000)",
    "sess_page": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urg') AND o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 26",
    "sess_budget": "SELECT conv_id, turn, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT *, CAST(greatest(1, length(text) // 2) AS INT) AS tokens FROM conversations)) WHERE t <= 600",
    "sess_limits": """SELECT event_id, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS INT) AS remaining, CAST(86400 - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS INT) AS reset_seconds
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)""",
    "sess_memory": "SELECT user_id AS session_id, event_type AS key, last(event_id ORDER BY ts, event_id) AS value, round(max(value), 6) AS confidence, bool_or(event_id % 7 = 0) AS confirmed FROM events GROUP BY user_id, event_type",
    "sess_jobs": f"""WITH j AS (SELECT user_id AS job_id, event_id, ts, {_JOB} AS status, CAST(floor(value) AS INT) AS progress FROM events), c AS (SELECT job_id, min((ts, event_id)) FILTER (status = 'cancelled') AS c FROM j GROUP BY job_id),
        l AS (SELECT j.*, row_number() OVER (PARTITION BY j.job_id ORDER BY ts DESC, event_id DESC) AS r FROM j JOIN c ON j.job_id = c.job_id WHERE c IS NULL OR (ts, event_id) <= c) SELECT job_id, status, greatest(0, least(100, progress)) AS progress FROM l WHERE r = 1""",
    "sess_lifecycle": "SELECT user_id, last(event_id ORDER BY ts, event_id) FILTER (event_type = 'signup') AS signup, last(event_id ORDER BY ts, event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
    "sess_upsert": "SELECT CASE WHEN c_nationkey < 5 THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM customer GROUP BY 1",
    "sess_rolling": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations)
        SELECT conv_id, count(*) AS n_messages, CAST(count(*) FILTER (role = 'user' AND k <= 2) AS INT) AS n_users, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND k <= 2), '')) AS users,
               sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND k <= 1), '')) AS assistants, concat_ws(',', CASE WHEN bool_or(contains(lower(text), 'the ')) THEN 'english' END, CASE WHEN bool_or(contains(lower(text), 'dans ')) THEN 'french' END) AS topics FROM r GROUP BY conv_id""",
    "stream_tumbling": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL",
    "stream_memory": "SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, last(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY user_id",
    "stream_limiter": "SELECT event_type, event_id, n, n <= 2 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events)",
    "stream_keyed": """WITH l AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey % 4 * 1000000000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)
        SELECT l.o_custkey, l.o_orderkey, o.o_orderstatus, (SELECT count(*) FROM orders x WHERE x.o_orderstatus = o.o_orderstatus) AS of_status FROM l JOIN orders o ON l.o_orderkey = o.o_orderkey""",
    "stream_limiter_daily": """SELECT event_id, user_id, n, n <= 2 AS allowed, CASE WHEN n <= 2 THEN 0 ELSE 86400 - CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 86400 END AS retry_after, false AS late
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)""",
    "stream_jobs": """
        WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts, CAST(floor(value) AS INT) AS progress,
                     CASE WHEN event_id % 4 <> 0 THEN 'validating' WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'click' THEN 'validating' WHEN event_type = 'view' THEN 'processing' WHEN event_type = 'purchase' THEN 'completed' ELSE 'cancelled' END AS status FROM events),
        o AS (SELECT *, coalesce(lag(ts) OVER w + INTERVAL 12 HOURS < ts, false) AS broke, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)),
        s AS (SELECT job_id, min(k) FILTER (broke) AS broke, min(k) FILTER (status IN ('completed', 'cancelled')) AS ended FROM o GROUP BY job_id),
        l AS (SELECT o.*, s.ended, s.broke FROM o JOIN s ON o.job_id = s.job_id WHERE k < coalesce(s.broke, 1e9) AND k <= coalesce(s.ended, 1e9)),
        f AS (SELECT job_id, arg_max(progress, k) AS progress, max(ts) AS ts, max(k) AS k, any_value(ended) AS ended, any_value(broke) AS broke, arg_max(status, k) AS last, bool_or(status = 'processing') AS p, bool_or(status = 'validating') AS v FROM l GROUP BY job_id),
        t AS (SELECT *, ts + INTERVAL 12 HOURS <= (SELECT date_trunc('second', max(ts)) + INTERVAL 1 SECOND FROM events) AS silent FROM f)
        SELECT job_id, CASE WHEN k = ended THEN last WHEN broke IS NOT NULL OR silent THEN 'failed' WHEN p THEN 'processing' WHEN v THEN 'validating' ELSE 'queued' END AS status, greatest(0, least(100, progress)) AS progress,
               strftime(CASE WHEN coalesce(k = ended, false) OR NOT (broke IS NOT NULL OR silent) THEN ts ELSE ts + INTERVAL 12 HOURS END, '%Y-%m-%d %H:%M:%S.%f') AS at FROM t
    """,
    "stream_first": "SELECT DISTINCT user_id, event_type FROM events",
}
