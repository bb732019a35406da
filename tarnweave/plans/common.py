"""Stand-ins that the queries share: documents as chunks with review columns, lexicons of the tables' own prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.operators.curation import Rules
from tarnweave.session import table

#: Dialogue rules whose patterns match the tables' invented prose.
PROSE = Rules().with_(
    high_risk="(euxau|nthare|gegen|ciónre)", safety_reply="(tion|ung|mente)", medication="(bleth|auxque|chver)", medication_safe="(sher|ierai)",
    flags={"direct_diagnosis": "(ontionon|lichge)", "recovery_guarantee": "(ndheha|keitver)", "professional_only_procedure": "(eauquech|ándoque)"},
    distress="(ing|eur|ßch|aba)", problems={"the": r"(\bthe\b)", "les": r"(\bles\b)", "und": r"(\bund\b)"}, focuses={"dans": "dans", "with": "with", "nicht": "nicht", "para": "para"},
    strategies={"open": "(ent|ver)", "label": "(hat|eau)", "plan": "(ist|ado)", "rest": "(zzzz)"}, problem_default="other", focus_default="none", group_default="everyone",
)

TAGS = {"english": ("the ", "that "), "french": ("dans ", "les "), "german": ("und ", "nicht "), "spanish": ("para ", "los "), "licence": ("license", "licence"), "contact": ("@",)}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: status from the label, collection by id, tags by words."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    place = F.pmod("doc_id", F.lit(4))
    from tarnweave.functions import text

    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("body").alias("section"),
        F.col("text").alias("content"), F.col("lang").alias("language"), status.alias("review_status"), F.col("n_chars").alias("char_count"), text.sha256(F.col("text")).alias("content_sha256"),
        F.element_at(F.array(*map(F.lit, ("interventions", "professional_knowledge", "campus_support", "safety"))), (place + 1).cast("int")).alias("target_collection"),
        F.when(place == 3, "safety_only").otherwise("direct_user_support").alias("use_mode"), F.when(place == 3, "safety_route_only").otherwise("normal").alias("risk_scope"),
        text.matching_labels(F.col("text"), TAGS).alias("topic_tags"), F.array(F.col("lang")).alias("population_tags"), F.when(F.col("doc_id") % 5 != 0, "CC-BY-4.0").alias("license"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("official_page_url"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("clinical_only"),
        (place != 3).alias("user_facing"), F.lit(True).alias("eligible_for_approval"), F.lit(False).alias("exclude_from_index"), F.lit("").alias("organization"), F.lit("").alias("evidence_level"),
    )


def _tag_sql(column: str = "text") -> str:
    rules = ", ".join("CASE WHEN {} THEN '{}' END".format(" OR ".join(f"contains(lower({column}), '{t}')" for t in terms), name) for name, terms in TAGS.items())
    return f"list_filter([{rules}], lambda x: x IS NOT NULL)"


#: The same as SQL.
CHUNKS_SQL = f"""
    chunks AS (
      SELECT d.doc_id AS chunk_id, source AS source_id, 'Document ' || d.doc_id AS title, 'body' AS section, text AS content, lang AS language,
             CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status, n_chars AS char_count, sha256(coalesce(text, '')) AS content_sha256,
             ['interventions', 'professional_knowledge', 'campus_support', 'safety'][CAST(d.doc_id % 4 AS INT) + 1] AS target_collection,
             CASE WHEN d.doc_id % 4 = 3 THEN 'safety_only' ELSE 'direct_user_support' END AS use_mode, CASE WHEN d.doc_id % 4 = 3 THEN 'safety_route_only' ELSE 'normal' END AS risk_scope,
             {_tag_sql()} AS topic_tags, [lang] AS population_tags, CASE WHEN d.doc_id % 5 <> 0 THEN 'CC-BY-4.0' END AS license,
             coalesce(toxic = 1, false) AS clinical_only, d.doc_id % 4 <> 3 AS user_facing
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
