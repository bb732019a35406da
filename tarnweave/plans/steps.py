"""Queries of single steps: sources and sinks by a folder written and read, session state, retrieval gates, ranking measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.functions import classify, numbers, text
from tarnweave.operators import evaluation, retrieval, review, sessions
from tarnweave.plans import common
from tarnweave.session import scratch_path, table
from tarnweave.sources import files, json_arrays, plugins, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- sources and sinks --------------------------------------------------------


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS digest FROM documents")
def file_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, read back."""
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents"), path)
    return files.jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", "lang", text.sha256(F.col("text")).alias("digest"))


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS digest FROM documents")
def file_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON arrays, one a file, read in blocks of a quarter of a megabyte; some records and strings span them."""
    path = scratch_path(spark, "json-array")
    docs = table(spark, sf_dir, "documents")
    lists = docs.groupBy(F.pmod("doc_id", F.lit(1 + docs.count() // 2_000)).alias("k")).agg(F.to_json(F.collect_list(F.struct("doc_id", "lang", "text"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 18))
    try:
        rows = json_arrays.json_records(spark, path, "doc_id long, lang string, text string")
    finally:
        spark.conf.set(name, before)
    return rows.select("doc_id", "lang", text.sha256(F.col("text")).alias("digest"))


@query("SELECT n_nationkey, n_name FROM nation")
def file_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one JSON object of records, read record by record."""
    path = scratch_path(spark, "json-object")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("nation, "), "n_nationkey"), F.struct("n_nationkey", "n_name")))))
    table(spark, sf_dir, "nation").agg(F.to_json(entries).alias("value")).write.text(path)
    return json_arrays.json_records(spark, path, "n_nationkey int, n_name string").select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_name, length(c_name) > 10 AS cut FROM customer")
def file_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV with a preview, read back."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_name", F.lit('\n"quoted", ')).alias("note"))
    sinks.write_csv(rows, path, {"note": 10})
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("c_custkey long, c_name string, note string").csv(path)
    return back.select("c_custkey", "c_name", ((F.length("note") == 10) & (F.length("c_name") > 10)).alias("cut"))


@query(f"WITH {common.CHUNKS_SQL} SELECT chunk_id, review_status, CASE review_status WHEN 'pending' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END AS status_rank FROM chunks")
def file_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in a folder per status, read back in one table."""
    path = scratch_path(spark, "by-status")
    sinks.write_by_status(common.chunks(spark, sf_dir).select("chunk_id", "review_status"), path)
    return sinks.read_by_status(spark, path).select("chunk_id", F.col("review_status").cast("string").alias("review_status"), "status_rank")


@query("SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier")
def file_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version published, a worse one refused, a later one rolled back: the first is current."""
    root, rows = scratch_path(spark, "published"), table(spark, sf_dir, "supplier")
    sinks.publish(rows, root, lambda df: df.limit(1).count() == 1)
    try:
        sinks.publish(rows.limit(0), root, lambda df: df.limit(1).count() == 1)
    except ValueError:
        pass
    sinks.publish(rows.where("s_suppkey % 2 = 0"), root, lambda df: True)
    sinks.roll_back(spark, root)
    return sinks.current(spark, root).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM orders GROUP BY 1")
def file_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of keys that come anew are replaced, others kept."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = rows.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("state"))
    return sinks.replace_keys(rows.select("o_orderkey", F.lit("old").alias("state")), new, "o_orderkey").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_id AS case_id FROM events WHERE event_type <> 'error'")
def file_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that a log of finished ones doesn't have."""
    path, cases = scratch_path(spark, "done"), table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), "event_type")
    sinks.write_jsonl(cases.where("event_type = 'error'").select("case_id"), path)
    return sinks.resume(cases, spark, path).select("case_id")


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def file_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was appended to twice."""
    path, rows = scratch_path(spark, "log"), table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.append_log(rows, path)
    sinks.append_log(rows, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


# --- text ---------------------------------------------------------------------


@query("""SELECT doc_id, source || '、' || lang AS label, 'a|b|c' AS parsed, coalesce(n_chars % 2 = 0, false) AS flag, source AS reply, CASE WHEN lang IS NOT NULL THEN '{"lang":"' || lang || '"}' END AS inner_json FROM documents""")
def text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List labels, delimited lists, lenient flags, replies after a thought, JSON in a fence."""
    yes = F.when(F.col("n_chars") % 2 == 0, F.lit(" Yes ")).otherwise("no")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.list_label(F.array(F.col("source"), F.lit(" "), F.col("lang"))).alias("label"), F.array_join(text.parse_list(F.lit("a, b;;c")), "|").alias("parsed"), text.lenient_bool(yes).alias("flag"),
        text.after_thinking(F.concat(F.lit("so </think> \""), "source", F.lit("\" "))).alias("reply"), text.json_object_in(F.concat(F.lit("```json\n"), F.to_json(F.struct("lang")), F.lit("\n```"))).alias("inner_json"),
    )


@query("SELECT page_id, CASE WHEN k = '' THEN 'anonymous' ELSE k END AS owner FROM (SELECT page_id, substr(regexp_replace(trim(url), '[^A-Za-z0-9:_\\-]', '', 'g'), 1, 128) AS k FROM pages)")
def text_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.owner_key(F.col("url")).alias("owner"))


@query("SELECT o_orderkey, CAST(bit_count(xor(CAST(o_orderkey AS INT), CAST(o_custkey AS INT))) AS INT) AS bits FROM orders")
def text_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing bits of two fingerprints."""
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.bits_apart(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int")).cast("int").alias("bits"))


@query("SELECT doc_id, round(n_chars / 1000 * 0.5 + length(source) / 1000 * 2.0, 6) AS price, CASE WHEN doc_id % 3 = 0 THEN 'CRISIS' WHEN contains(lang, 'e') THEN 'SAFE' ELSE source END AS reply FROM documents")
def class_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of a call, and replies that a template overrides."""
    level = F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low")
    unsafe = F.when(F.contains("lang", F.lit("e")), F.concat(F.lit("unsafe "), "source")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.cost(F.col("n_chars"), F.length("source"), 0.5, 2.0).alias("price"), classify.reviewed_reply(unsafe, level, "^unsafe", "CRISIS", "SAFE").alias("reply"))


@query("""SELECT p_partkey, p_size + 40 AS score, CASE WHEN p_size + 40 >= 80 THEN 'accept' WHEN p_size + 40 >= 65 THEN 'review' WHEN p_size + 40 >= 50 THEN 'hold' ELSE 'reject' END AS decision,
    CASE p_partkey % 4 WHEN 0 THEN 'safety_only' WHEN 1 THEN 'evidence_only' WHEN 2 THEN 'psychoeducation_only' ELSE 'direct_user_support' END AS mode FROM part""")
def class_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and use modes of candidate sources."""
    place = (F.col("p_partkey") % 4).cast("int")
    of = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), place + 1)
    score = classify.source_quality(F.col("p_size"), F.lit(20), F.lit(10), F.lit(5), F.lit(3), F.lit(2))
    return table(spark, sf_dir, "part").select("p_partkey", score["score"].alias("score"), score["decision"].alias("decision"), classify.use_mode(of("safety", "evidence", "other", "other"), F.lit(False), of("book", "book", "A Guideline", "book")).alias("mode"))


# --- sessions -----------------------------------------------------------------


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = 1")
def sess_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.single_user_message(table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the ') THEN 'english' WHEN trim(text) = '' OR text IS NULL THEN '-' ELSE substr(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 12) END AS title FROM conversations")
def sess_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.fallback_title(F.col("text"), {"english": ("the ",)}, default="-").alias("title"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'")
def sess_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.expired(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS memory FROM (SELECT user_id, event_type, max(event_id) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def sess_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of each owner as one map."""
    items = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    entries = F.array_sort(F.map_entries("memory"))
    return sessions.snapshot(items, "user_id").select("user_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("memory"))


@query("SELECT doc_id, CASE WHEN source = lang THEN source ELSE source || ',' || lang END AS both, lang AS over, source AS under FROM documents")
def sess_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's map over the global one; listed keys keep the values of both."""
    one = lambda **kv: F.create_map(*(x for k, c in kv.items() for x in (F.lit(k), F.array(F.col(c)))))
    merged = sessions.merge_maps(one(liked="lang", tone="lang"), one(liked="source", tone="source", style="source"), ("liked",))
    return table(spark, sf_dir, "documents").select("doc_id", merged.alias("m")).select("doc_id", F.array_join(F.col("m")["liked"], ",").alias("both"), F.col("m")["tone"][0].alias("over"), F.col("m")["style"][0].alias("under"))


@query("SELECT conv_id FROM (SELECT conv_id, count(*) AS n, CASE WHEN conv_id % 2 = 0 THEN 3 END AS s FROM conversations GROUP BY conv_id) WHERE n >= 5 AND n - coalesce(s, 0) >= 4")
def sess_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues whose summary is to be made again."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages")).withColumn("summarised", F.when(F.col("conv_id") % 2 == 0, 3))
    return sessions.summary_due(counts, 5, 4).select("conv_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'F' THEN 'completed' ELSE 'queued' END AS status FROM orders")
def sess_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recover(_jobs(spark, sf_dir)).select(F.col("job_id").alias("o_orderkey"), "status")


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus NOT IN ('O', 'F') ORDER BY o_orderdate, o_orderkey LIMIT 1")
def sess_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.next_job(_jobs(spark, sf_dir))


@query("SELECT o_custkey AS session_id, count(*) FILTER (o_orderstatus <> 'F') AS active FROM orders GROUP BY o_custkey")
def sess_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.active_counts(_jobs(spark, sf_dir))


@query("""SELECT event_id, n + coalesce(b, 0) <= 40 AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)
    LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS b FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey) USING (user_id)""")
def sess_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come in beside the jobs that run already."""
    asked = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return sessions.admissions(asked, _jobs(spark, sf_dir), 40).select("event_id", "admitted")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '10.0.0.' || c_nationkey WHEN c_nationkey < 9 THEN 'proxy' ELSE 'unknown' END AS client, CASE c_mktsegment WHEN 'BUILDING' THEN 'chat' WHEN 'MACHINERY' THEN 'report' ELSE 'api' END AS bucket, CASE WHEN c_acctbal > 0 THEN c_name ELSE '***' END AS name FROM customer")
def sess_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client keys behind trusted proxies, buckets of paths, and a column that some may not see."""
    peer = F.when(F.col("c_nationkey") < 9, "proxy")
    forwarded = F.when(F.col("c_nationkey") < 5, F.concat(F.lit(" 10.0.0."), F.col("c_nationkey").cast("string"), F.lit(" , proxy")))
    path = F.when(F.col("c_mktsegment") == "BUILDING", "/chat/1").when(F.col("c_mktsegment") == "MACHINERY", "/report").otherwise("/x")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", sessions.client_key(peer, forwarded, ["proxy"]).alias("client"), sessions.path_bucket(path, {"/chat": "chat", "/report": "report"}).alias("bucket"), sessions.visible(F.col("c_acctbal") > 0, F.col("c_name"), "***").alias("name"),
    )


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS deleted, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS stay")
def sess_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    stay, deleted = sessions.delete_key(table(spark, sf_dir, "orders"), gone, "o_custkey")
    return deleted.crossJoin(stay.agg(F.count("*").alias("stay")))  # one row each


@query("SELECT c_nationkey AS owner, o_orderkey, r AS rank FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 20")
def sess_own_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty rows on each owner's own conversations."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("owner"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "session_id")
    return sessions.own_recent(rows, own, "owner", order=("o_orderdate", "o_orderkey")).select("owner", "o_orderkey", "rank")


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def sess_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five hundred metrics."""
    return sessions.latest_rows(table(spark, sf_dir, "events"), ("ts", "event_id"), 500).select("event_id", "value")


@query("SELECT event_id FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) ORDER BY event_id LIMIT 100")
def sess_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred cases of the run that was written last."""
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    return sessions.latest_run_cases(rows, rows, ("ts", "event_id"), "event_id").select("event_id")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "processing").when(F.col("o_orderstatus") == "F", "completed").otherwise("queued")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))


# --- review -------------------------------------------------------------------


@query(f"WITH {common.CHUNKS_SQL} SELECT source_id, count(*) AS n, string_agg(chunk_id || ':' || language, ',' ORDER BY chunk_id) AS chunks FROM chunks GROUP BY source_id")
def review_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their chunks in order."""
    chunks = common.chunks(spark, sf_dir).withColumn("chunk_index", F.col("chunk_id"))
    rows = review.source_with_chunks(chunks.select("source_id").distinct(), chunks, columns=("chunk_id", "language"))
    return rows.select("source_id", F.size("chunks").cast("long").alias("n"), F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_id"].cast("string"), c["language"])), ",").alias("chunks"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 100")
def review_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.lowest_selected(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("""SELECT p_name AS title, p_brand AS source, 'https://example.org/' || p_partkey AS official_url, '' AS why_useful, p_type || ',x' AS population, '' AS topic, '' AS license, 'manual_review_or_manual_download' AS access_type,
    CASE WHEN p_size + 40 >= 65 THEN 'P1' ELSE 'P2' END AS priority FROM part WHERE NOT (p_size % 2 = 0 AND p_partkey % 5 <> 0)""")
def review_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person must fetch or look at."""
    none = F.lit(None).cast("string")
    return review.manual_rows(table(spark, sf_dir, "part").select(
        F.col("p_name").alias("title"), F.col("p_brand").alias("organization"), F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("official_url"), none.alias("decision_reason"), F.array("p_type", F.lit("x")).alias("population"),
        F.lit(None).cast("array<string>").alias("topics"), none.alias("license"), (F.col("p_size") % 2 == 0).alias("downloadable"), F.lit(None).cast("boolean").alias("auto_download"), F.when(F.col("p_partkey") % 5 == 0, "manual_review").alias("decision"), (F.col("p_size") + 40).alias("source_quality_score"),
    ))


@query(f"""WITH {common.CHUNKS_SQL}, i AS (SELECT chunk_id, list_filter([CASE WHEN license IS NULL OR trim(license) = '' THEN 'missing:license' END, CASE WHEN length(coalesce(content, '')) < 80 THEN 'too_short' END, CASE WHEN length(coalesce(content, '')) > 2500 THEN 'too_long' END,
    CASE WHEN contains(content, chr(65533)) THEN 'replacement_character' END], lambda x: x IS NOT NULL) AS issues FROM chunks) SELECT chunk_id, array_to_string(issues, ',') AS issues FROM i WHERE len(issues) > 0""")
def review_quality_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with an issue, not only those of the report."""
    return review.quality_issues(common.chunks(spark, sf_dir), ["license"], limit=None).select("chunk_id", F.array_join("issues", ",").alias("issues"))


# --- retrieval ----------------------------------------------------------------

_EXPAND = {"the": ("one", "two"), "and": ("three",), "of": ("four", "five", "six", "seven")}


@query("""
    WITH t AS (SELECT item_id, concat_ws(',', CASE WHEN item_id % 2 = 0 THEN 'calm,soothe' END, CASE WHEN item_id % 3 = 0 THEN 'exam' END) AS terms FROM benchmark) SELECT item_id, terms, terms <> '' OR contains(lower(text), 'the ') AS inside FROM t JOIN benchmark USING (item_id)""")
def query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a context, and whether a query belongs here."""
    emotion = F.when(F.col("item_id") % 2 == 0, " Anxiety ").otherwise("neutral")
    cause = F.when(F.col("item_id") % 3 == 0, "study").otherwise("general")
    terms = retrieval.context_terms({"emotion": emotion, "cause": cause}, {"anxiety": ("calm", "soothe"), "study": ("exam",)})
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(terms, ",").alias("terms"), retrieval.in_domain(F.col("text"), ("the ",), (emotion, cause)).alias("inside"))


@query("""WITH c AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark),
    e AS (SELECT item_id, q, list_slice(list_concat(list_concat(CASE WHEN contains(q, 'the') THEN ['one', 'two'] ELSE [] END, CASE WHEN contains(q, 'and') THEN ['three'] ELSE [] END), CASE WHEN contains(q, 'of') THEN ['four', 'five', 'six', 'seven'] ELSE [] END), 1, 6) AS x FROM c)
    SELECT item_id, trim(q || ' ' || array_to_string(x, ' ')) AS expanded FROM e""")
def query_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with at most six expansions."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.trim(retrieval.expanded_query(F.col("text"), _EXPAND)).alias("expanded"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN text || ' safety planning crisis referral a b' WHEN 1 THEN text || ' psychoeducation professional help a b' ELSE text END AS asked,
    CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN 'safety' WHEN item_id % 3 = 1 AND item_id % 2 = 0 THEN 'professional_knowledge' ELSE 'interventions,professional_knowledge,campus_support' END AS collections FROM benchmark""")
def query_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as the queries and collections that they are run with."""
    modes = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("safety_only"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("psychoeducation_only"))).otherwise(F.array().cast("array<string>"))
    asked, allowed = retrieval.case_request(F.col("text"), modes, F.array(F.lit("a"), F.lit("b")), F.col("item_id") % 2 == 1)
    return table(spark, sf_dir, "benchmark").select("item_id", asked.alias("asked"), F.array_join(allowed, ",").alias("collections"))


@query("""WITH l AS (SELECT doc_id, [0, 1, 2][CAST(doc_id % 3 AS INT) + 1] AS c, CAST(floor(doc_id / 3) AS BIGINT) % 3 AS d FROM documents)
    SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.35 WHEN 2 THEN 0.55 ELSE 0.0 END AS DOUBLE) AS field,
           CAST(CASE WHEN d = 2 THEN CASE c WHEN 2 THEN 1.0 WHEN 1 THEN 0.65 ELSE 0.25 END WHEN d = 1 THEN CASE c WHEN 1 THEN 1.0 WHEN 2 THEN 0.3 ELSE 0.7 END ELSE CASE c WHEN 2 THEN 0.05 WHEN 1 THEN 0.55 ELSE 1.0 END END AS DOUBLE) AS risk FROM l""")
def rank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of a field, and how a risk level serves another."""
    at = lambda values, place: F.element_at(F.array(*map(F.lit, values)), place.cast("int") + 1)
    candidate = at(("en, x", "general", "englishspeakers", "other"), F.col("doc_id") % 4)
    levels = ("low", "medium", "high")
    return table(spark, sf_dir, "documents").select(
        "doc_id", retrieval.field_score(retrieval.value_set(candidate), retrieval.value_set(F.lit("English|en"))).alias("field"), retrieval.risk_compatibility(at(levels, F.col("doc_id") % 3), at(levels, F.floor(F.col("doc_id") / 3) % 3)).alias("risk"),
    )


# --- evaluation ---------------------------------------------------------------


@query("SELECT n_name, r_name, n_name <> '' AND r_name <> '' AND (n_name = r_name OR (length(n_name) >= 5 AND length(r_name) >= 5 AND (contains(n_name, r_name) OR contains(r_name, n_name)))) AS alike FROM nation JOIN region ON n_regionkey = r_regionkey")
def eval_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", "r_name", evaluation.fuzzy_tag(F.col("n_name"), F.col("r_name")).alias("alike"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.col("source").alias("case_id"), F.col("lang").alias("method"), place.alias("rank"))


_RANKED = "r AS (SELECT *, source AS case_id, lang AS method, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents)"


@query(f"""WITH {_RANKED} SELECT case_id, method, round(count(*) FILTER (n_chars % 3 = 1) / greatest(1, count(*) FILTER (n_chars % 3 <> 0)), 4) AS wrong_population_retrieval_rate, round(count(*) FILTER (doc_id % 2 = 1) / count(*), 4) AS wrong_use_mode_retrieval_rate,
    round(count(*) FILTER (doc_id % 7 = 0) / count(*), 4) AS safety_leakage_rate, round((count(*) - count(DISTINCT n_chars % 4)) / count(*), 4) AS duplicate_retrieval_rate, round(count(*) FILTER (doc_id % 5 = 1) / nullif(count(*) FILTER (doc_id % 5 <> 0), 0), 4) AS language_preference_accuracy
    FROM r WHERE rank <= 5 GROUP BY case_id, method""")
def eval_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of wrong, leaked and repeated results."""
    rows = _ranked(spark, sf_dir).select(
        "case_id", "method", "rank", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") % 3 == 2).alias("compatible"), (F.col("doc_id") % 2 == 0).alias("mode_expected"), (F.col("doc_id") % 7 == 0).alias("leaks"),
        (F.col("n_chars") % 4).alias("content_key"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 1).alias("language_hit"),
    )
    return evaluation.guardrail_rows(rows)


@query(f"""WITH {_RANKED}, o AS (SELECT case_id, method, min(rank) FILTER (doc_id % 3 = 0) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (doc_id % 3 = 0), 0) AS dcg, count(*) FILTER (doc_id % 3 = 0) AS h,
      max(CASE WHEN rank <= 1 AND doc_id % 3 = 0 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN rank <= 3 AND doc_id % 3 = 0 THEN 1 ELSE 0 END) AS h3, max(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS h5 FROM r WHERE rank <= 5 GROUP BY ALL)
    SELECT case_id, method, round(coalesce(1 / first, 0), 4) AS mrr_at_5, round(CASE WHEN h > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i) WHERE i <= h) ELSE 0 END, 4) AS ndcg_at_5, h1 = 1 AS hit_at_1, h3 = 1 AS hit_at_3, h5 = 1 AS hit_at_5,
      CAST(method = 'en' AS INT)::DOUBLE AS recall_at_5, method = 'en' AS topic_hit_at_5 FROM o""")
def eval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, topic recall, MRR and nDCG of each case and method."""
    rows = _ranked(spark, sf_dir).select("case_id", "method", "rank", F.col("case_id").alias("source_id"), F.array("method").alias("topics"), (F.col("doc_id") % 3 == 0).alias("relevant"))
    cases = rows.select("case_id", "method").distinct().select("case_id", "method", F.array(F.lit("en")).alias("expected_topics"), F.array().cast("array<string>").alias("expected_sources"))
    return evaluation.ranking_rows(rows, cases).select("case_id", "method", "mrr_at_5", "ndcg_at_5", "hit_at_1", "hit_at_3", "hit_at_5", "recall_at_5", "topic_hit_at_5")


@query("""SELECT doc_id, CASE WHEN c = '' THEN 'OK' ELSE c END AS codes FROM (SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 11 = 0 THEN 'NO_RELEVANT_SOURCE' END, CASE WHEN doc_id % 2 = 1 THEN CASE lang WHEN 'en' THEN 'BM25_TOKENIZATION_FAILURE' WHEN 'fr' THEN 'DENSE_SEMANTIC_FAILURE' ELSE CASE WHEN doc_id % 3 = 0 THEN 'RRF_FUSION_FAILURE' ELSE 'WRONG_TOPIC' END END END,
    CASE WHEN doc_id % 5 > 0 THEN 'WRONG_POPULATION' END, CASE WHEN doc_id % 7 = 0 THEN 'TOO_MANY_DUPLICATES' END, CASE WHEN n_chars < 80 THEN 'CHUNK_TOO_SMALL' END) AS c FROM documents)""")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why cases failed."""
    method = F.when(F.col("lang") == "en", "bm25").when(F.col("lang") == "fr", "dense").otherwise("hybrid")
    guard = {"population": F.col("doc_id") % 5, "mode": F.lit(0), "leak": F.lit(0), "duplicate": F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(0.0)}
    codes = evaluation.failure_codes(method, F.col("doc_id") % 11 == 0, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, guard, F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"))


@query("SELECT round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic FROM labels")
def eval_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluation.flag_rates(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return rates.select(*(F.round(c, 9).alias(c) for c in rates.columns))


@query("SELECT suite, count(*) AS n FROM (SELECT 'events' AS suite FROM events WHERE event_type = 'error' UNION ALL SELECT 'labels' FROM labels WHERE toxic = 1) GROUP BY suite")
def eval_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of two suites in one table."""
    parts = {"events": table(spark, sf_dir, "events").where("event_type = 'error'"), "labels": table(spark, sf_dir, "labels").where("toxic = 1")}
    return evaluation.suite_union(parts).groupBy("suite").agg(F.count("*").alias("n"))


@query("SELECT 'c' || lpad(CAST(row_number() OVER (ORDER BY r_regionkey, k) AS VARCHAR), 3, '0') AS case_id, r_name AS topic, CASE k WHEN 0 THEN r_name ELSE 'x' END AS message FROM region, range(0, 2) t(k)")
def eval_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases numbered through topics and messages."""
    topics = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("topic"), F.array("r_name", F.lit("x")).alias("messages"))
    return evaluation.numbered_cases(topics, "c")


@query(None)
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows by the hash of their id: the operator samples."""
    return evaluation.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "doc_id")


@query("SELECT event_type, concat_ws(',', CASE WHEN event_type <> 'click' THEN 'rag' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'memory' END) AS parts FROM (SELECT DISTINCT event_type FROM events)")
def eval_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts each variant of a system has."""
    flags = plugins.system_flags(F.col("event_type"), {"click": ("rag", "memory"), "view": ("memory",)}, ("rag", "memory"))
    rows = table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", flags.alias("f"))
    return rows.select("event_type", F.concat_ws(",", *(F.when(F.col("f")[c], c) for c in ("rag", "memory"))).alias("parts"))
