"""Queries of classifiers, rubric scores and smaller session and registry steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import classify, text
from tarnweave.operators import evaluation, review, sessions
from tarnweave.session import table

LEX = {"english": ("the ", "that ", "with "), "french": ("dans ", "les ", "pour "), "german": ("und ", "nicht ", "mit "), "spanish": ("para ", "los ", "con ")}
TERMS = {
    "empathy": ("the ", "les ", "und "), "reflection": ("that ", "dans "), "question": ("for ", "que "), "action": ("to ", "pour "), "unsafe": ("zzz",), "toxic": ("xxx",), "crisis": ("with ", "mit "),
    "person": ("is ",), "source": ("and ",), "hedge": ("est ",),
}


def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.best_label(F.col("text"), LEX, "none").alias("b")).select("doc_id", "b.label", "b.confidence", F.array_join("b.evidence", "|").alias("evidence"))


def class_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", classify.first_cause(F.col("text"), {"licence": ("license", "licence"), "contact": ("@",), "english": (" the ",)}).alias("c"))
    return rows.select("doc_id", "c.category", F.array_join("c.evidence_terms", "|").alias("terms"))


#: Terms of the invented prose; "the" and "und" deny what follows them.
RISK = classify.RiskLexicon(
    high=("tion", "keit", "ment"), medium=("ing", "eur"), report=("and ", "les "), fiction=("zu ",), intent=("to ",), plan=("ver",), time=("an",), means=("is",), others=("er",),
    phrases=("with",), negations=("the ", "und "), near_negations=("nicht",), denials={"ment": ("les ", "que ")},
)


def class_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns against a lexicon of the invented prose: level, terms, dimensions, evidence."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.assess_risk({"text": F.col("text")}, RISK).alias("r"))
    seen = F.coalesce(F.get("r.evidence", F.lit(0))["content"], F.lit(""))
    return rows.select(
        "conv_id", "turn", "r.level", "r.action", "r.context", F.array_join("r.matched_terms", ",").alias("terms"), F.size("r.matched_sources").alias("n_sources"), "r.dimensions.ideation", "r.dimensions.plan",
        "r.dimensions.timeframe_present", "r.dimensions.means_access", "r.dimensions.immediacy", "r.dimensions.harm_to_others", "r.dimensions.negated", "r.dimensions.third_party_report", seen.alias("evidence"),
    )


def class_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a message to emotion, cause, needs, stage, plan and route."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("e", classify.emotion(F.col("text"), {"anxiety": ("ing ", "eur "), "joy": ("the ",), "sadness": ("und ",)}))
    rows = rows.withColumn("cause", classify.first_cause(F.col("text"), {"sleep": ("dans ",), "exam": (" the ",), "family": ("und ",)})["category"])
    rows = rows.withColumn("need", classify.needs(F.col("text"), F.col("e.label"), F.col("e.intensity"), F.col("cause"), F.lit("low"), {"information": ("est ",), "problem_solving": ("to ",)}))
    rows = rows.withColumn("confidence", classify.state_confidence(F.col("text"), F.col("e.label"), F.col("e.intensity"), F.col("cause"), F.col("need"), F.lit("low")))
    rows = rows.withColumn("stage", classify.stage(F.col("text"), F.col("cause"), F.col("need"), F.col("confidence")))
    rows = rows.withColumn("plan", classify.plan(F.lit("low"), F.col("e.label"), F.col("cause"), F.col("stage"), F.col("need"), F.col("confidence")))
    route = classify.route(F.col("text"), F.lit("low"), F.col("plan.should_use_rag"), F.col("confidence"), F.col("cause"), F.col("e.label"), F.col("plan.primary_strategy"), F.col("need"), {"licence": ("license",)}, {"sleep": ("sleep", "rest")}, {"sleep": ("interventions",)}, {"information": ("psychoeducation",)})
    rows = rows.withColumn("route", route)
    return rows.select("conv_id", "turn", "e.label", "e.intensity", "cause", F.array_join("need", ",").alias("needs"), "confidence", "stage", "plan.primary_strategy", "plan.reason", "route.should_retrieve", F.array_join("route.collections", ",").alias("collections"), F.array_join("route.topics", ",").alias("topics"))


def class_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "anger").when(F.col("event_type") == "view", "joy").otherwise("calm").alias("label"), (F.col("user_id") % 12).alias("stress"))
    d = classify.emotion_dimensions(F.col("label"), F.lit(0.5), F.col("stress"))
    return rows.select("event_id", d.alias("d")).select("event_id", F.col("d.valence.score").alias("valence"), F.col("d.valence.label").alias("sign"), F.col("d.arousal.score").alias("arousal"), F.col("d.control.label").alias("control"))


def eval_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    no, yes = F.lit(False), F.lit(True)
    m = evaluation.rubric(F.col("text"), TERMS, no, yes, no, no, no, no, no, no)
    return rows.select("conv_id", "turn", *(m[n].alias(n.lower().replace(" ", "_")) for n in ("Empathy", "Information", "Safety", "Fluency", "Overall Quality", "Toxicity")))


def eval_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("value", F.lit(10.0).alias("low"), F.lit(60.0).alias("high"))
    return evaluation.interval_accuracy(rows, "value", "low", "high").select("n", F.round("accuracy", 6).alias("accuracy"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return evaluation.crossed_cases(scenarios, 6, "c").select("case_id", "repeat", "name")


def sess_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.with_sequence(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey", ["o_orderkey"])
    return sessions.max_sequence(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), rows, "o_custkey")


def sess_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.valid_feedback(table(spark, sf_dir, "events"), {"value": (5, 50)})
    r = sessions.session_report(rows, "event_type", ["value"], "user_id", 3)
    return r.select("event_type", "n", "value", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


def sess_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return sessions.missing_parents([o, s], table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k")), "k")


def sess_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = sessions.evidence_rows(c, {"user_text": F.when(F.col("role") == "user", F.col("text")), "reply": F.when(F.col("role") == "assistant", F.col("text"))}, ["conv_id", "turn"])
    return e.groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("longest"))


def sess_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("emotion"), F.array(F.lit("2-HIGH")).alias("disliked"), F.array(F.lit("3-MEDIUM")).alias("preferred"))
    library = spark.createDataFrame([(i, s, k, f"{s} {k}") for i, (s, k) in enumerate((s, k) for s in ("BUILDING", "MACHINERY", "AUTOMOBILE") for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-NONE"))], "place int, emotion string, kind string, title string")
    return sessions.recommend(people, library)


def review_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("title"), F.lit("keep").alias("decision"), F.lit("base").alias("download")).where("source_id < 15")
    added = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.lower("n_name").alias("title"), F.when(F.col("n_regionkey") == 1, "rejected").otherwise("accept").alias("decision"), F.lit("added").alias("download")).where("source_id >= 10")
    return review.merge_registry(base, added)


def text_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.allowed_asset(u, F.lit(""), extensions=("1", "3")).alias("wanted"), F.array_join(text.domains_for(u), ",").alias("domains"))


QUERIES = {f.__name__: f for f in (class_labels, class_cause, class_risk, class_state, class_dimensions, eval_rubric, eval_interval, eval_cases, sess_max, sess_feedback, sess_missing, sess_evidence, sess_recommend, review_registry, text_assets)}

_n = lambda terms, c="text": "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms) + ")"
_e = "round(least(5.0, greatest(1.0, 2.2 + {e} * 0.55 + {r} * 0.25)), 2)".format(e=_n(TERMS["empathy"]), r=_n(TERMS["reflection"]))
_host = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"

_win = "substr(low, greatest(1, instr(low, t) - 8), instr(low, t) - greatest(1, instr(low, t) - 8) + length(t) + 8)"
_deny = f"CASE WHEN t = 'ment' THEN contains(low, 'les ') OR contains(low, 'que ') ELSE contains({_win}, 'the ' || t) OR contains({_win}, 'und ' || t) OR contains(left({_win}, 8), 'nicht') OR contains({_win}, 'with') END"
RISK_SQL = f"""
    WITH b AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body, lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) AS low FROM conversations),
    h AS (SELECT *, list_filter(['tion', 'keit', 'ment'], lambda t: contains(low, t) AND NOT ({_deny})) AS hits, list_filter(['tion', 'keit', 'ment'], lambda t: contains(low, t) AND ({_deny})) AS denied,
                 list_filter(['ing', 'eur'], lambda t: contains(body, t)) AS medium, (contains(low, 'and ') OR contains(low, 'les ')) AND (contains(low, 'zu ') OR NOT contains(low, 'to ')) AS told FROM b),
    r AS (SELECT *, len(hits) > 0 AS high, len(medium) > 0 AS mid, len(hits) = 0 AND len(medium) = 0 AND len(denied) > 0 AS no FROM h),
    s AS (SELECT *, CASE WHEN high AND told THEN 'medium' WHEN high THEN 'high' WHEN mid THEN 'medium' ELSE 'low' END AS level, CASE WHEN high THEN hits WHEN mid THEN medium ELSE [] END AS terms,
                 (CASE WHEN high THEN hits WHEN mid THEN medium ELSE denied END)[1] AS shown FROM r)
    SELECT conv_id, turn, level, CASE level WHEN 'high' THEN 'crisis_referral' WHEN 'medium' THEN 'support_with_monitoring' ELSE 'normal_support' END AS action,
           CASE WHEN high AND told THEN 'reported_or_quoted' WHEN no THEN 'negated_high_risk' ELSE 'none' END AS context, array_to_string(terms, ',') AS terms, CAST(len(terms) > 0 AS INT) AS n_sources, high AS ideation,
           high AND contains(low, 'ver') AS plan, high AND contains(low, 'an') AS timeframe_present, CASE WHEN NOT high THEN 'none' WHEN contains(low, 'is') THEN 'present' ELSE 'unknown' END AS means_access,
           CASE WHEN high AND contains(low, 'an') THEN 'high' WHEN high THEN 'medium' ELSE 'low' END AS immediacy, contains(low, 'er') AND NOT no AS harm_to_others, no AS negated, high AND told AS third_party_report,
           coalesce(substr(body, greatest(1, instr(low, shown) - 30), instr(low, shown) - greatest(1, instr(low, shown) - 30) + length(shown) + 30), '') AS evidence
    FROM s
"""

ORACLE = {
    "class_risk": RISK_SQL,
    "class_labels": "WITH f AS (SELECT doc_id, " + ", ".join(f"list_filter({list(v)!r}, lambda t: contains(lower(text), t)) AS l{i}" for i, v in enumerate(LEX.values())) + " FROM documents), "
    "s AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS place, '{k}' AS label, l{i} AS ev, len(l{i}) AS n, length(array_to_string(l{i}, '')) AS size FROM f" for i, k in enumerate(LEX)) + "), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC, place) AS r FROM s) SELECT doc_id, CASE WHEN n > 0 THEN label ELSE 'none' END AS label, CASE WHEN n > 0 THEN round(least(0.58 + n * 0.12, 0.9), 2) ELSE 0.35 END AS confidence, array_to_string(list_slice(ev, 1, 5), '|') AS evidence FROM r WHERE r = 1",
    "class_cause": """SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'licence') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN contains(lower(text), ' the ') THEN 'english' WHEN regexp_matches(text, '\\S') THEN 'other' ELSE 'unknown' END AS category,
        CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'licence') THEN concat_ws('|', CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN contains(lower(text), 'licence') THEN 'licence' END) WHEN contains(text, '@') THEN '@' WHEN contains(lower(text), ' the ') THEN ' the ' ELSE '' END AS terms FROM documents""",
    "class_dimensions": """WITH b AS (SELECT event_id, CASE event_type WHEN 'error' THEN -0.58 WHEN 'view' THEN 0.72 ELSE 0.0 END AS v, CASE event_type WHEN 'error' THEN 0.82 WHEN 'view' THEN 0.55 ELSE 0.35 END AS a, CASE event_type WHEN 'error' THEN 0.32 WHEN 'view' THEN 0.68 ELSE 0.55 END AS c, least(1.0, (user_id % 12) / 10) AS s FROM events),
        r AS (SELECT event_id, round(CAST(greatest(-1.0, least(1.0, v - s * 0.18::DOUBLE)) AS DOUBLE), 2) AS v, round(CAST(greatest(0.0, least(1.0, a + s * 0.14::DOUBLE)) AS DOUBLE), 2) AS a, round(CAST(greatest(0.0, least(1.0, c - s * 0.16::DOUBLE)) AS DOUBLE), 2) AS c FROM b)
        SELECT event_id, v AS valence, CASE WHEN v >= 0.25 THEN 'positive' WHEN v <= -0.25 THEN 'negative' ELSE 'neutral' END AS sign, a AS arousal, CASE WHEN c >= 0.67 THEN 'high' WHEN c >= 0.34 THEN 'medium' ELSE 'low' END AS control FROM r""",
    "eval_rubric": f"""WITH m AS (SELECT conv_id, turn, {_e} AS empathy, round(2.6 + 0.85 + CASE WHEN {_n(TERMS['source'])} > 0 THEN 0.35 ELSE 0 END + CASE WHEN {_n(TERMS['hedge'])} > 0 THEN 0.25 ELSE 0 END, 2) AS information, 4.6 AS safety,
        CASE WHEN length(trim(text)) < 35 THEN 2.0 WHEN length(trim(text)) BETWEEN 70 AND 420 THEN 4.2 WHEN length(trim(text)) <= 560 THEN 3.8 ELSE 3.0 END AS fluency, round(2.2 + CASE WHEN {_n(TERMS['action'])} > 0 THEN 0.5 ELSE 0 END + 0.35, 2) AS spec FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, empathy, information, safety, fluency, round((CAST(empathy AS DOUBLE) + CAST(spec AS DOUBLE) + CAST(safety AS DOUBLE) + CAST(information AS DOUBLE)) / 4, 2) AS overall_quality, 0.0 AS toxicity FROM m""",
    "eval_interval": "SELECT count(*) AS n, round(avg(CAST(value BETWEEN 10 AND 60 AS INT)), 6) AS accuracy FROM events",
    "eval_cases": "SELECT 'c' || lpad(CAST(row_number() OVER (ORDER BY r, n_nationkey) AS VARCHAR), 4, '0') AS case_id, CAST(r AS INT) AS repeat, n_name AS name FROM nation, range(1, 7) AS t(r)",
    "sess_max": "SELECT c_custkey AS o_custkey, count(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "sess_feedback": """WITH r AS (SELECT * FROM events WHERE value IS NULL OR value BETWEEN 5 AND 50), c AS (SELECT event_type, user_id, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM c)
        SELECT r.event_type, count(*) AS n, round(avg(value), 2) AS value, (SELECT string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY k) FROM k WHERE k <= 3 AND k.event_type = r.event_type) AS top FROM r GROUP BY r.event_type""",
    "sess_missing": "SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 20",
    "sess_evidence": "SELECT CASE role WHEN 'user' THEN 'user_text' ELSE 'reply' END AS source, count(*) AS n, CAST(max(least(180, length(trim(text)))) AS INT) AS longest FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY 1",
    "sess_recommend": """WITH l AS (SELECT unnest(range(0, 15)) AS place), b AS (SELECT place, ['BUILDING', 'MACHINERY', 'AUTOMOBILE'][CAST(place // 5 AS INT) + 1] AS emotion, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-LOW', '5-NONE'][CAST(place % 5 AS INT) + 1] AS kind FROM l),
        j AS (SELECT c_custkey AS person, kind, emotion || ' ' || kind AS title, kind = '3-MEDIUM' AS preference_match, row_number() OVER (PARTITION BY c_custkey ORDER BY kind = '3-MEDIUM' DESC, place) AS rank FROM customer JOIN b ON c_mktsegment = emotion WHERE kind <> '2-HIGH')
        SELECT person, rank, kind, title, preference_match FROM j WHERE rank <= 3""",
    "review_registry": """SELECT n_nationkey AS source_id, CASE WHEN n_nationkey >= 10 THEN lower(n_name) ELSE n_name END AS title, CASE WHEN n_nationkey >= 10 THEN 'accept' ELSE 'keep' END AS decision, CASE WHEN n_nationkey < 15 THEN 'base' ELSE 'added' END AS download FROM nation WHERE NOT (n_nationkey >= 10 AND n_regionkey = 1)""",
    "text_assets": rf"SELECT page_id, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '[13]$') AS wanted, h || ',www.' || h AS domains FROM (SELECT *, {_host} AS h FROM pages)",
}
