"""Queries of retrieval and review over documents as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.operators import evaluation, lexicon, retrieval, review
from tarnweave.plans import common
from tarnweave.session import settle, table

#: A lexicon of the invented prose, as people keep one: triggers and terms by topic.
LEXICON = [
    (0, "english", ["the ", "that "], ["with"], ["the", "and"]),
    (1, "french", ["dans ", "les "], ["pour"], ["dans", "avec"]),
    (2, "german", ["und ", "nicht "], ["mit"], ["und", "der"]),
    (3, "spanish", ["para ", "los "], ["con"], ["para", "del"]),
]
PEOPLE = [(0, "fr", ["dans "]), (1, "de", ["und "])]
LEX_SCHEMA = "place int, topic string, triggers array<string>, zh_terms array<string>, en_terms array<string>"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, sf_dir: str) -> retrieval.LexicalIndex:
    return retrieval.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), 5).select("query_id", "doc_id", F.round("raw_score", 5).alias("raw_score"), "score", "rank")


def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 5).select("query_id", "doc_id", "score", "rank")


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 3, "l2", partition="label").select("query_id", "label", "doc_id", "rank")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two searches: by inner product, and by distance within a label."""
    e, q = table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)
    dot = retrieval.nearest(e, q, 10).select("query_id", F.col("doc_id").alias("chunk_id"), F.lit("dense").alias("source"), "rank", "score")
    l2 = retrieval.nearest(e, q, 3, "l2", partition="label").select("query_id", F.col("doc_id").alias("chunk_id"), F.lit("bm25").alias("source"), "rank", "score")
    return settle(dot.unionByName(l2), "found")


def fuse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retrieval.merge_candidates(_found(spark, sf_dir))
    return m.select("query_id", "chunk_id", "dense_rank", "bm25_rank", F.array_join("retrieval_sources", ",").alias("sources"))


def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retrieval.with_rrf(retrieval.merge_candidates(_found(spark, sf_dir)), 45)
    return m.select("query_id", "chunk_id", "rrf_score", "rrf_score_norm")


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex, people = spark.createDataFrame(LEXICON, LEX_SCHEMA), spark.createDataFrame(PEOPLE, "place int, population string, triggers array<string>")
    r = retrieval.rewrite_queries(_queries(spark, sf_dir), lex, people)
    return r.select("query_id", F.array_join("matched_topics", ",").alias("topics"), F.array_join("en_terms", ",").alias("en_terms"), F.array_join("populations", ",").alias("populations"), F.size("query_variants").alias("n_variants"), "contains_cjk")


def lexicon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each word of the benchmark, as a part of whatever."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    return lexicon.matches(table(spark, sf_dir, "documents"), words).groupBy("term").agg(F.count("*").alias("n_docs"))


def retrieve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hybrid chain; a chain of rounded scores without SQL, whose steps are tested one by one."""
    chunks = settle(common.chunks(spark, sf_dir).where(retrieval.eligible_for_index()), "chunks")
    lex, people = spark.createDataFrame(LEXICON, LEX_SCHEMA), spark.createDataFrame(PEOPLE, "place int, population string, triggers array<string>")
    asked = settle(retrieval.rewrite_queries(_queries(spark, sf_dir), lex, people), "asked")
    bm = retrieval.bm25(retrieval.build_index(chunks), asked, 20, query="expanded_query").select("query_id", F.col("doc_id").alias("chunk_id"), F.lit("bm25").alias("source"), "rank", "score")
    vec = lambda df, i, c: df.select(F.col(i).alias("vec_id"), retrieval.hashed_embedding(F.col(c)).alias("embedding"))
    keys = asked.select((-F.col("query_id") - 1).alias("k"), "query_id", "expanded_query")  # apart from chunk ids
    dense = retrieval.nearest(vec(chunks, "chunk_id", "content"), vec(keys, "k", "expanded_query"), 20)
    dense = dense.select((-F.col("query_id") - 1).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit("dense").alias("source"), "rank", "score")
    return retrieval.retrieve(asked, chunks, bm.unionByName(dense), 5).drop("content")


def index_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = common.chunks(spark, sf_dir)
    prod, stag = retrieval.eligible_for_index("production"), retrieval.eligible_for_index()
    shown = retrieval.user_facing() & retrieval.review_allowed(F.col("review_status"))
    return c.groupBy("target_collection").agg(F.count_if(prod).alias("production"), F.count_if(stag).alias("staging"), F.count_if(shown).alias("shown"))


def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = retrieval.matches_filter({"target_collection": ["interventions", "safety"], "topics": ["english", "licence"], "review_status": ["approved", "pending"]})
    return common.chunks(spark, sf_dir).where(f).select("chunk_id", "target_collection", "review_status")


def ranked_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.chunks(spark, sf_dir).withColumns({"query_id": F.col("source_id"), "rerank_score": F.round(F.col("char_count") / 1000.0, 1)})
    return retrieval.dedupe_ranked(rows).select("query_id", "chunk_id")


def search_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("query_id", F.col("source"))
    rows = retrieval.top_k(rows.withColumn("s", F.col("n_chars").cast("double")), "s", 20, tie="doc_id")
    return rows.select("query_id", "doc_id", F.round(retrieval.min_max("s"), 6).alias("norm"), retrieval.share_of_best("s").alias("share"))


# --- review -----------------------------------------------------------------


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = common.chunks(spark, sf_dir)
    return evaluation.value_counts(c, ["review_status", "target_collection", "language", "source_id", "use_mode", "risk_scope", "topic_tags"])


def review_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.value_counts(common.chunks(spark, sf_dir), ["source_id", "topic_tags"], top=3)


def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = common.chunks(spark, sf_dir)
    return c.select("chunk_id", F.array_join(review.automatic_issues(c), ",").alias("issues"))


def review_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.quality_issues(common.chunks(spark, sf_dir), ["license", "topic_tags"]).select("chunk_id", F.array_join("issues", ",").alias("issues"))


def review_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.source_summary(common.chunks(spark, sf_dir))


def review_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.source_balance(common.chunks(spark, sf_dir))


def review_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses before and after a source's eligible pending chunks were approved."""
    c = common.chunks(spark, sf_dir)
    after, _ = review.bulk_approve(c, "src1", "reviewer")
    return review.status_change(c, after)


def review_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = common.chunks(spark, sf_dir)
    e = review.eligibility(c, ["interventions", "professional_knowledge"])
    return c.select("target_collection", e.alias("e")).groupBy("target_collection", "e.reason").agg(F.count("*").alias("n"))


def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in ("english", "french", "german", "spanish", "licence", "contact", "absent")], "label string")
    return review.tag_coverage(common.chunks(spark, sf_dir), labels, chinese="fr")


def review_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.topic_share(common.chunks(spark, sf_dir).where("review_status = 'approved'"), ["english", "french", "absent"])
    return r.select(F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "share")


def review_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.missing_metadata(common.chunks(spark, sf_dir), ["license", "topic_tags", "content", "organization"])


def review_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = review.duplicate_content(common.chunks(spark, sf_dir))
    return d.select("content_sha256", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("sources", ",").alias("sources"))


def review_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.char_stats(common.chunks(spark, sf_dir))


def review_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("interventions",), ("evidence",), ("safety",)], "target_collection string")
    return review.completeness(common.chunks(spark, sf_dir), wanted)


def review_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"some_approved": F.count_if(F.col("review_status") == "approved") > 0, "all_licensed": F.count_if(F.col("license").isNull()) == 0, "no_pending": F.count_if(F.col("review_status") == "pending") == 0}
    return review.readiness(checks, common.chunks(spark, sf_dir)).select("passed", F.array_join("blockers", ",").alias("blockers"))


def review_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = common.chunks(spark, sf_dir)
    q = review.queues(c, {"p0_safety": F.col("target_collection") == "safety", "p1_long": F.col("char_count") > 2500, "p1_french": F.col("language") == "fr"}, "p2_general")
    return q.select(F.explode("queues").alias("queue")).groupBy("queue").agg(F.count("*").alias("n"))


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from the labels' toxic flags, two for some chunks, applied to chunks that are all pending."""
    c = common.chunks(spark, sf_dir).select("chunk_id", F.lit("pending").alias("review_status"))
    lab = table(spark, sf_dir, "labels")
    d = lab.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "approved").otherwise("pending").alias("review_status"), F.col("quality").alias("reviewed_at")).union(lab.where("toxic = 1").select("doc_id", F.lit("blocked"), F.lit(2)))
    return review.apply_history(c, d.withColumn("review_status", review.normal_status(F.col("review_status"))), columns=("review_status",)).groupBy("review_status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, bm25_terms, knn_dot, knn_l2, fuse_merge, fuse_rrf, query_rewrite, lexicon_matches, retrieve_chain, index_eligible, policy_filter, ranked_dedupe, search_min_max, review_counts, review_top_values,
        review_issues, review_quality_report, review_sources, review_balance, review_bulk, review_eligibility, review_coverage, review_topics, review_missing, review_duplicates, review_lengths,
        review_complete, review_ready, review_queues, review_history,
    )
}

_TERMS = """
    tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS ts FROM documents),
    dl AS (SELECT doc_id, len(ts) AS dl FROM tok), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean FROM dl),
    post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY term, doc_id),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term),
    idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""
_DOT = """
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0),
    dot AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(qv, v), 6) AS score FROM q, e WHERE vec_id <> query_id AND list_inner_product(qv, v) > 0),
    l2 AS (SELECT query_id, vec_id AS doc_id, CAST(label AS VARCHAR) AS label, round(1 / (1 + sqrt(greatest(list_inner_product(qv, qv) - 2 * list_inner_product(qv, v) + list_inner_product(v, v), 0))), 6) AS score FROM q, e WHERE vec_id <> query_id),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dot), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) AS rank FROM l2)
"""
_MERGED = _DOT + """,
    f AS (SELECT query_id, doc_id AS chunk_id, 'dense' AS source, rank FROM dr WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'bm25', rank FROM lr WHERE rank <= 3),
    mer AS (SELECT query_id, chunk_id, min(rank) FILTER (source = 'dense') AS dense_rank, min(rank) FILTER (source = 'bm25') AS bm25_rank, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM f GROUP BY ALL)
"""
_C = f"WITH {common.CHUNKS_SQL}"
_hit = lambda terms: "(" + " OR ".join(f"contains(lower(query), '{t}')" for t in terms) + ")"
_trim = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

_ISSUES = """list_filter([CASE WHEN license IS NULL THEN 'missing:license' END, CASE WHEN len(topic_tags) = 0 THEN 'missing:topic_tags' END, CASE WHEN length(content) < 80 THEN 'too_short' END, CASE WHEN length(content) > 2500 THEN 'too_long' END,
    CASE WHEN clinical_only AND user_facing THEN 'clinical_only_marked_user_facing' END, CASE WHEN target_collection = 'safety' THEN 'requires_chunk_level_high_risk_review' END], lambda x: x IS NOT NULL)"""
_ISSUES_ORDERED = """list_filter([CASE WHEN NOT regexp_matches(coalesce(content, ''), '\\S') THEN 'missing:content' END, CASE WHEN len(topic_tags) = 0 THEN 'missing:topic_tags' END, CASE WHEN license IS NULL THEN 'missing:license' END, CASE WHEN length(content) < 80 THEN 'too_short' END, CASE WHEN length(content) > 2500 THEN 'too_long' END,
    CASE WHEN clinical_only AND user_facing THEN 'clinical_only_marked_user_facing' END, CASE WHEN target_collection = 'safety' THEN 'requires_chunk_level_high_risk_review' END], lambda x: x IS NOT NULL)"""
_COUNTED = """
    v AS (SELECT unnest(['review_status', 'target_collection', 'language', 'source_id', 'use_mode', 'risk_scope']) AS dimension, unnest([review_status, target_collection, language, source_id, use_mode, risk_scope]) AS value FROM chunks
          UNION ALL SELECT 'topic_tags', unnest(topic_tags) FROM chunks),
    cv AS (SELECT dimension, value, count(*) AS n FROM v GROUP BY ALL)
"""

ORACLE = {
    "bm25_terms": f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "lexicon_matches": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark)
        SELECT term, count(DISTINCT doc_id) AS n_docs FROM t JOIN documents ON contains(lower(documents.text), term) GROUP BY term""",
    "bm25_search": f"""WITH {_TERMS},
        qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 / mean * dl))), 9) AS s FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), n GROUP BY query_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s WHERE s > 0)
        SELECT query_id, doc_id, round(s, 5) AS raw_score, round(s / max(s) OVER (PARTITION BY query_id), 4) AS score, rank FROM r WHERE rank <= 5""",
    "knn_dot": f"WITH {_DOT} SELECT query_id, doc_id, score, rank FROM dr WHERE rank <= 5",
    "knn_l2": f"WITH {_DOT} SELECT query_id, label, doc_id, rank FROM lr WHERE rank <= 3",
    "fuse_merge": f"WITH {_MERGED} SELECT * FROM mer",
    "fuse_rrf": f"""WITH {_MERGED}, s AS (SELECT query_id, chunk_id, coalesce(1.0 / (45 + dense_rank), 0) + coalesce(1.0 / (45 + bm25_rank), 0) AS s FROM mer)
        SELECT query_id, chunk_id, round(s, 8) AS rrf_score, round(round(s, 8) / max(s) OVER (PARTITION BY query_id), 4) AS rrf_score_norm FROM s""",
    "query_rewrite": f"""WITH q AS (SELECT item_id AS query_id, {_trim} AS query FROM benchmark),
        m AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_hit(t)} THEN '{n}' END" for _, n, t, _, _ in LEXICON)}], lambda x: x IS NOT NULL) AS t,
                     flatten([{', '.join(f"CASE WHEN {_hit(t)} THEN {e} ELSE [] END" for _, _, t, _, e in LEXICON)}]) AS e, list_filter([{', '.join(f"CASE WHEN {_hit(t)} THEN '{n}' END" for _, n, t in PEOPLE)}], lambda x: x IS NOT NULL) AS p FROM q)
        SELECT query_id, array_to_string(t, ',') AS topics, array_to_string(e, ',') AS en_terms, array_to_string(p, ',') AS populations, CAST(CASE WHEN len(t) = 0 THEN 1 ELSE 4 END AS INT) AS n_variants, regexp_matches(query, '[一-鿿]') AS contains_cjk FROM m""",
    "index_eligible": f"{_C} SELECT target_collection, count(*) FILTER (review_status = 'approved' AND regexp_matches(content, '\\S')) AS production, count(*) FILTER (review_status <> 'rejected' AND regexp_matches(content, '\\S')) AS staging, count(*) FILTER (review_status <> 'rejected' AND user_facing AND NOT clinical_only) AS shown FROM chunks GROUP BY ALL",
    "policy_filter": f"{_C} SELECT chunk_id, target_collection, review_status FROM chunks WHERE target_collection IN ('interventions', 'safety') AND list_has_any(topic_tags, ['english', 'licence']) AND review_status IN ('approved', 'pending')",
    "ranked_dedupe": f"{_C} SELECT source_id AS query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, content_sha256 ORDER BY round(char_count / 1000.0, 1) DESC, chunk_id) AS r FROM chunks) WHERE r = 1",
    "search_min_max": """WITH r AS (SELECT source AS query_id, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), t AS (SELECT * FROM r WHERE r <= 20)
        SELECT query_id, doc_id, round(CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN 1.0 ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w) END, 6) AS norm, round(n_chars / max(n_chars) OVER w, 4) AS share FROM t WINDOW w AS (PARTITION BY query_id)""",
    "review_counts": f"{_C}, {_COUNTED} SELECT * FROM cv",
    "review_top_values": f"{_C}, {_COUNTED} SELECT dimension, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM cv WHERE dimension IN ('source_id', 'topic_tags')) WHERE r <= 3",
    "review_issues": f"{_C} SELECT chunk_id, array_to_string({_ISSUES_ORDERED}, ',') AS issues FROM chunks",
    "review_quality_report": f"""{_C} SELECT chunk_id, array_to_string(i, ',') AS issues FROM (SELECT chunk_id, list_filter([CASE WHEN license IS NULL THEN 'missing:license' END, CASE WHEN len(topic_tags) = 0 THEN 'missing:topic_tags' END,
        CASE WHEN length(content) < 80 THEN 'too_short' END, CASE WHEN length(content) > 2500 THEN 'too_long' END, CASE WHEN contains(content, '�') THEN 'replacement_character' END], lambda x: x IS NOT NULL) AS i FROM chunks) WHERE len(i) > 0 ORDER BY chunk_id LIMIT 200""",
    "review_sources": f"""{_C} SELECT source_id, count(*) AS chunk_count, count(*) FILTER (len(i) = 0) AS eligible, count(*) FILTER (len(i) > 0) AS held, count(*) FILTER (target_collection = 'safety') AS high_risk_chunks,
        count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'rejected') AS rejected FROM (SELECT *, {_ISSUES_ORDERED} AS i FROM chunks) GROUP BY source_id""",
    "review_balance": f"{_C} SELECT source_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM chunks GROUP BY source_id",
    "review_bulk": f"""{_C} SELECT target_collection AS collection, review_status AS before, CASE WHEN source_id = 'src1' AND review_status = 'pending' AND len({_ISSUES_ORDERED}) = 0 THEN 'approved' ELSE review_status END AS after, count(*) AS n FROM chunks GROUP BY ALL""",
    "review_eligibility": f"""{_C} SELECT target_collection, CASE WHEN review_status = 'rejected' THEN 'already_rejected' WHEN target_collection NOT IN ('interventions', 'professional_knowledge') THEN 'collection_not_in_scope' WHEN NOT regexp_matches(content, '\\S') THEN 'empty_content'
        WHEN license IS NULL THEN 'missing_license' WHEN clinical_only AND user_facing THEN 'clinical_only_user_facing' WHEN length(content) < 80 THEN 'too_short' WHEN length(content) > 2500 THEN 'too_long' ELSE 'eligible' END AS reason, count(*) AS n FROM chunks GROUP BY ALL""",
    "review_coverage": f"""{_C}, t AS (SELECT source_id, language, unnest(topic_tags) AS label FROM chunks), g AS (SELECT label, count(DISTINCT source_id) AS sources, count(*) AS chunks, count(*) FILTER (starts_with(language, 'fr')) AS native FROM t GROUP BY label),
        w AS (SELECT unnest(['english', 'french', 'german', 'spanish', 'licence', 'contact', 'absent']) AS label), j AS (SELECT w.label, coalesce(sources, 0) AS sources, coalesce(chunks, 0) AS chunks, coalesce(native, 0) AS native FROM w LEFT JOIN g ON w.label = g.label)
        SELECT *, CASE WHEN sources >= 3 AND chunks >= 12 THEN 'Strong' WHEN sources >= 2 AND chunks >= 5 THEN 'Adequate' WHEN sources >= 1 AND chunks >= 1 THEN CASE WHEN native > 0 THEN 'Adequate' ELSE 'Weak' END ELSE 'Missing' END AS rating FROM j""",
    "review_topics": f"{_C}, s AS (SELECT DISTINCT unnest(topic_tags) AS t FROM chunks WHERE review_status = 'approved') SELECT coalesce(string_agg(t, ',' ORDER BY t) FILTER (t IN ('english', 'french', 'absent')), '') AS covered, 'absent' AS missing, round(count(*) FILTER (t IN ('english', 'french', 'absent')) / 3, 4) AS share FROM s",
    "review_missing": f"{_C} SELECT unnest(['license', 'topic_tags', 'content', 'organization']) AS field, unnest([count(*) FILTER (license IS NULL), count(*) FILTER (len(topic_tags) = 0), count(*) FILTER (NOT regexp_matches(content, '\\S')), count(*)]) AS missing FROM chunks",
    "review_duplicates": f"""{_C}, g AS (SELECT content_sha256, count(*) AS n, list_sort(list(chunk_id)) AS ids, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM chunks GROUP BY content_sha256 HAVING count(*) > 1 ORDER BY n DESC, content_sha256 LIMIT 50)
        SELECT content_sha256, n, array_to_string(list_slice(ids, 1, 10), ',') AS ids, sources FROM g""",
    "review_lengths": f"{_C} SELECT round(avg(char_count), 2) AS mean, median(char_count) AS median, list_sort(list(char_count))[greatest(1, CAST(floor(count(*) * 0.95) AS INT))] AS p95 FROM chunks",
    "review_complete": f"{_C}, w AS (SELECT unnest(['interventions', 'evidence', 'safety']) AS target_collection) SELECT w.target_collection, count(chunk_id) AS n, CASE WHEN count(chunk_id) = 0 THEN 'empty' ELSE 'ready' END AS state FROM w LEFT JOIN chunks ON w.target_collection = chunks.target_collection GROUP BY ALL",
    "review_ready": f"{_C} SELECT false AS passed, concat_ws(',', CASE WHEN count(*) FILTER (review_status = 'approved') = 0 THEN 'some_approved' END, CASE WHEN count(*) FILTER (license IS NULL) > 0 THEN 'all_licensed' END, CASE WHEN count(*) FILTER (review_status = 'pending') > 0 THEN 'no_pending' END) AS blockers FROM chunks",
    "review_queues": f"""{_C}, u AS (SELECT 'p0_safety' AS queue FROM chunks WHERE target_collection = 'safety' UNION ALL SELECT 'p1_long' FROM chunks WHERE char_count > 2500 UNION ALL SELECT 'p1_french' FROM chunks WHERE language = 'fr'
        UNION ALL SELECT 'p2_general' FROM chunks WHERE target_collection <> 'safety' AND char_count <= 2500 AND language <> 'fr') SELECT queue, count(*) AS n FROM u GROUP BY queue""",
    "review_history": "SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS review_status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
}
