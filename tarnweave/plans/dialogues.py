"""Queries of dialogue curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.operators import curation, selection
from tarnweave.plans.common import PROSE
from tarnweave.session import scratch_path, settle, table
from tarnweave.streaming import duplicates as stream

_P = PROSE


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.records(table(spark, sf_dir, "conversations"), PROSE)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.with_metrics(curation.with_labels(_records(spark, sf_dir), PROSE), PROSE)


def conv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select("conv_id", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.sha2(curation.all_text(F.col("messages")), 256).alias("digest"), "empty_raw_messages", "unknown_role_messages", "source_system_messages")


def conv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["turn_count", "assistant_turns", "user_turns", "characters", "estimated_tokens", "assistant_mean_chars", "low_information_ratio", "repeated_assistant_ratio", "high_risk_user", "safety_adequate", "high_risk_immediate_safety"]
    return _measured(spark, sf_dir).select("conv_id", *names, F.array_join("boundary_flags", "|").alias("flags"))


def conv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.with_labels(_records(spark, sf_dir), PROSE).select("conv_id", "problem", "support_focus", F.array_join("strategy_path", "|").alias("strategies"), "severity", "group", "cause")


def conv_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("conv_id", F.coalesce(curation.reject_reason(), F.lit("kept")).alias("reason"))


def conv_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_reject_reason(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def conv_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.label_counts(curation.with_labels(_records(spark, sf_dir), PROSE)).select("field", "value", "n", "total")


def conv_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.distribution(curation.with_labels(_records(spark, sf_dir), PROSE), "strategy_path", 3)


def conv_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = curation.length_percentiles(_measured(spark, sf_dir))
    return p.select("name", *(F.col("percentiles")[f"p{k}"].alias(f"p{k}") for k in (1, 5, 50, 90, 95, 99)))


def conv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all dialogues that aren't rejected."""
    recs = _measured(spark, sf_dir)
    kept = recs.where(curation.reject_reason().isNull())
    return curation.with_scores(kept, curation.label_counts(kept)).select("conv_id", "quality_score", "coverage_score", "final_score")


def conv_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-message records: exact, normalised and fingerprint copies of earlier ones (brute force in the tests)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages"))
    return curation.duplicates(curation.with_hashes(docs))


def stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: documents in two batches, the second one twice, hashed ahead of the sink (held against ``conv_duplicates`` in the tests)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages"))
    docs = settle(curation.with_hashes(docs).drop("messages"), "hashed-documents")
    end, path = docs.agg(F.max("conv_id")).first()[0] or 0, scratch_path(spark, "duplicates")
    take = stream.duplicates_sink(path)
    for epoch in (0, 1, 1):
        take(docs.where((F.col("conv_id") * 2 >= epoch * (end + 1)) & (F.col("conv_id") * 2 < (epoch + 1) * (end + 1))), epoch)
    return stream.tables(path)[1].read(spark)


def conv_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain, 400 dialogues of 800 candidates; the selection is held against a plain version in the tests."""
    return curation.curate(table(spark, sf_dir, "conversations"), 400, 800, PROSE)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with labels and scores: sources as groups, a quarter of high severity."""
    c = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        c, F.col("source").alias("group"), F.col("lang").alias("problem"), F.concat(F.lit("c"), (c % 7).cast("string")).alias("cause"), F.concat(F.lit("f"), (c % 11).cast("string")).alias("support_focus"),
        F.when(c % 4 == 0, "high").when(c % 4 == 1, "medium").otherwise("low").alias("severity"), F.array(F.concat(F.lit("s"), (c % 13).cast("string")), F.concat(F.lit("s"), (c % 17).cast("string"))).alias("strategy_path"),
        (c % 20).cast("double").alias("coverage_score"), ((c * 37 % 1_000) / 10).alias("final_score"),
    )


def conv_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of the sources for a target of 400."""
    by = F.struct((-F.col("final_score")).alias("f"), "doc_id")
    strata = _labelled(spark, sf_dir).groupBy(F.col("group").alias("stratum")).agg(F.count("*").alias("n"), F.min(by).alias("at"))
    return selection.quotas(strata, int(400 * selection.KEPT_SHARE))


def conv_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps of the labels for a target of 400."""
    pairs = _labelled(spark, sf_dir).select(F.explode(curation.label_pairs()).alias("p")).select("p.field", "p.value")
    caps = selection.label_caps(pairs, 400)
    part = lambda k: F.element_at(F.split("key", "\x1f"), k)
    return caps.select(part(1).alias("field"), part(2).alias("value"), "cap")


def conv_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 documents of the best 2,000, balanced over labels."""
    return curation.select_balanced(curation.top_pool(_labelled(spark, sf_dir), 2_000, id_col="doc_id"), 400, "doc_id")


def conv_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curation.chat_rows(_records(spark, sf_dir), " Be kind. ")
    return rows.select("conv_id", F.size("messages").alias("n"), F.sha2(curation.all_text(F.col("messages")), 256).alias("digest"))


def conv_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.structure_errors(curation.chat_rows(_records(spark, sf_dir), "Be kind.")).select("rows", "bad", F.to_json("errors").alias("errors"))


QUERIES = {f.__name__: f for f in (conv_records, stream_duplicates, conv_metrics, conv_labels, conv_reject_reason, conv_reject_counts, conv_label_counts, conv_distribution, conv_percentiles, conv_scores, conv_duplicates, conv_curate, conv_quotas, conv_caps, conv_select, conv_chat, conv_structure)}

_CLEAN = r"""trim(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10))"""
_EMAIL = r"regexp_replace(regexp_replace({}, '(?i)https?://\S+|www\.\S+', '[URL]', 'g'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g')"
RECORDS = f"""
    t AS (SELECT conv_id, turn, role, CASE lower(trim(role)) WHEN 'system' THEN 'source_system' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS kind, {_EMAIL.format(_CLEAN)} AS content FROM conversations),
    u AS (SELECT *, content <> '' AND coalesce(kind IN ('user', 'assistant'), false) AS usable FROM t),
    b AS (SELECT *, last_value(CASE WHEN usable THEN kind END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
    r AS (SELECT *, sum(CASE WHEN usable AND before IS DISTINCT FROM kind THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, content ROWS UNBOUNDED PRECEDING) AS run FROM b),
    m AS (SELECT conv_id, run, max(kind) AS role, string_agg(content, chr(10) ORDER BY turn, role, content) AS content FROM r WHERE usable GROUP BY conv_id, run),
    e AS (SELECT conv_id, min(run) FILTER (role = 'user') AS first, max(run) FILTER (role = 'assistant') AS last FROM m GROUP BY conv_id),
    msgs AS (SELECT m.* FROM m JOIN e ON m.conv_id = e.conv_id AND run BETWEEN first AND last),
    stats AS (SELECT conv_id, CAST(count(*) FILTER (content = '') AS BIGINT) AS empty_raw_messages, CAST(count(*) FILTER (content <> '' AND kind IS NULL) AS BIGINT) AS unknown_role_messages,
                     CAST(count(*) FILTER (content <> '' AND kind = 'source_system') AS BIGINT) AS source_system_messages FROM t GROUP BY conv_id)
"""
_any = lambda pattern, role: f"coalesce(bool_or(regexp_matches(content, '{pattern}')) FILTER (role = '{role}'), false)"
_flag = {"direct_diagnosis": _P.flags["direct_diagnosis"], "recovery_guarantee": _P.flags["recovery_guarantee"], "professional_only_procedure": _P.flags["professional_only_procedure"]}
METRICS = RECORDS + f""",
    s AS (SELECT *, lead(role) OVER w AS r1, lead(content) OVER w AS c1, lead(role, 2) OVER w AS r2, lead(content, 2) OVER w AS c2 FROM msgs WINDOW w AS (PARTITION BY conv_id ORDER BY run)),
    g AS (SELECT conv_id, CAST(count(*) AS INT) AS turn_count, CAST(count(*) FILTER (role = 'assistant') AS INT) AS assistant_turns, CAST(count(*) FILTER (role = 'user') AS INT) AS user_turns,
                 CAST(sum(length(content)) + count(*) - 1 AS INT) AS characters, sum(len(regexp_extract_all(content, '[A-Za-z0-9]+'))) AS words,
                 round(sum(CASE WHEN role = 'assistant' THEN length(content) ELSE 0 END) / greatest(1, count(*) FILTER (role = 'assistant')), 2) AS assistant_mean_chars,
                 round(count(*) FILTER (role = 'assistant' AND length(trim(content)) < 12) / greatest(1, count(*) FILTER (role = 'assistant')), 4) AS low_information_ratio,
                 round(greatest(0, greatest(1, count(*) FILTER (role = 'assistant')) - count(DISTINCT regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')) FILTER (role = 'assistant')) / greatest(1, count(*) FILTER (role = 'assistant')), 4) AS repeated_assistant_ratio,
                 {_any(_P.high_risk, 'user')} AS high_risk_user, {_any(_P.safety_reply, 'assistant')} AS safety_adequate,
                 {_any(_P.high_risk, 'user')} AND bool_and(NOT (role = 'user' AND regexp_matches(content, '{_P.high_risk}')) OR CASE WHEN r1 = 'assistant' THEN regexp_matches(c1, '{_P.safety_reply}') WHEN r2 = 'assistant' THEN regexp_matches(c2, '{_P.safety_reply}') ELSE false END) AS high_risk_immediate_safety,
                 {_any(_P.medication, 'assistant')} AND NOT {_any(_P.medication_safe, 'assistant')} AS f0, {_any(_flag['direct_diagnosis'], 'assistant')} AS f1, {_any(_flag['recovery_guarantee'], 'assistant')} AS f2, {_any(_flag['professional_only_procedure'], 'assistant')} AS f3
          FROM s GROUP BY conv_id),
    met AS (SELECT stats.*, coalesce(turn_count, 0) AS turn_count, coalesce(assistant_turns, 0) AS assistant_turns, coalesce(user_turns, 0) AS user_turns, coalesce(characters, 0) AS characters,
                   CAST(greatest(1, floor(coalesce(words, 0) * 1.2::DOUBLE + coalesce(characters, 0) * 0.12::DOUBLE)) AS INT) AS estimated_tokens, coalesce(assistant_mean_chars, 0.0) AS assistant_mean_chars,
                   coalesce(low_information_ratio, 0.0) AS low_information_ratio, coalesce(repeated_assistant_ratio, 1.0) AS repeated_assistant_ratio, coalesce(high_risk_user, false) AS high_risk_user, coalesce(safety_adequate, false) AS safety_adequate,
                   coalesce(high_risk_immediate_safety, false) AS high_risk_immediate_safety,
                   concat_ws('|', CASE WHEN f0 THEN 'medication_directive' END, CASE WHEN f1 THEN 'direct_diagnosis' END, CASE WHEN f2 THEN 'recovery_guarantee' END, CASE WHEN f3 THEN 'professional_only_procedure' END) AS flags
            FROM stats LEFT JOIN g ON stats.conv_id = g.conv_id)
"""
REASON = """CASE WHEN turn_count < 2 THEN 'broken_conversation' WHEN user_turns = 0 THEN 'no_user_message' WHEN assistant_turns = 0 THEN 'no_assistant_message'
    WHEN unknown_role_messages > greatest(2.0, turn_count * 0.3) THEN 'role_mapping_failed' WHEN low_information_ratio >= 0.7 THEN 'low_information' WHEN assistant_mean_chars < 16 AND turn_count < 8 THEN 'assistant_too_short'
    WHEN estimated_tokens < 80 THEN 'too_short_for_sft' WHEN estimated_tokens > 5200 THEN 'too_long_for_single_sft_sample' WHEN flags <> '' THEN 'unsafe_boundary_' || flags
    WHEN high_risk_user AND NOT high_risk_immediate_safety THEN 'high_risk_without_safety_response' END"""
_matched = lambda rules, c: "concat_ws('{}', " + ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{n}' END" for n, p in rules.items()) + ")"
LABELS = f"""
    x AS (SELECT stats.conv_id, coalesce(string_agg(content, chr(10) ORDER BY run) FILTER (role = 'user'), '') AS u, coalesce(string_agg(content, chr(10) ORDER BY run) FILTER (role = 'assistant'), '') AS a, coalesce(string_agg(content, chr(10) ORDER BY run), '') AS e
          FROM stats LEFT JOIN msgs ON stats.conv_id = msgs.conv_id GROUP BY stats.conv_id),
    lab AS (SELECT conv_id, e, CASE {' '.join(f"WHEN regexp_matches(u, '{p}') THEN '{n}'" for n, p in _P.problems.items())} ELSE '{_P.problem_default}' END AS problem,
                   coalesce(nullif(array_to_string(list_slice(list_filter([{', '.join(f"CASE WHEN regexp_matches(e, '{p}') THEN '{n}' END" for n, p in _P.focuses.items())}], lambda v: v IS NOT NULL), 1, 3), '、'), ''), '{_P.focus_default}') AS support_focus,
                   coalesce(nullif({_matched(_P.strategies, 'a').format('|')}, ''), 'supportive_dialogue') AS strategies,
                   CASE WHEN regexp_matches(u, '{_P.high_risk}') THEN 'high' WHEN regexp_matches(u, '{_P.distress}') THEN 'medium' ELSE 'low' END AS severity, '{_P.group_default}' AS "group", 'unknown_cause' AS cause FROM x)
"""
PAIRS = """
    pairs AS (SELECT conv_id, unnest(['group', 'problem', 'cause', 'support_focus', 'severity']) AS field, unnest(["group", problem, cause, support_focus, severity]) AS value FROM {0}
              UNION ALL SELECT conv_id, 'strategy', unnest(string_split(strategies, '|')) FROM {0}),
    cnt AS (SELECT field, value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY field) AS BIGINT) AS total FROM pairs WHERE value <> 'unknown' GROUP BY field, value)
"""
_METRIC_NAMES = "conv_id, turn_count, assistant_turns, user_turns, characters, estimated_tokens, assistant_mean_chars, low_information_ratio, repeated_assistant_ratio, high_risk_user, safety_adequate, high_risk_immediate_safety, flags"

ORACLE = {
    "conv_structure": f"""WITH {RECORDS}, c AS (SELECT stats.conv_id, count(run) + 1 AS n FROM stats LEFT JOIN msgs ON stats.conv_id = msgs.conv_id AND regexp_matches(content, '\\S') GROUP BY stats.conv_id),
        er AS (SELECT *, CASE WHEN n < 3 THEN 'too_few_messages' END AS error, row_number() OVER (PARTITION BY n < 3 ORDER BY conv_id) AS k FROM c)
        SELECT count(*) AS rows, count(error) AS bad, coalesce(CAST(to_json(list(struct_pack(id := conv_id, error := error) ORDER BY conv_id) FILTER (error IS NOT NULL AND k <= 20)) AS VARCHAR), '[]') AS errors FROM er""",
    "conv_quotas": """
        WITH s AS (SELECT source AS stratum, count(*) AS n, -max((doc_id * 37 % 1000) * 100000000 - doc_id) AS top FROM documents GROUP BY source),
        w AS (SELECT stratum, top, greatest(1, CAST(round_even(n / (SELECT sum(n) FROM s) * 240, 0) AS BIGINT)) AS want FROM s),
        v AS (SELECT coalesce(max(k), 1) AS level FROM range(1, 241) t(k) WHERE (SELECT sum(least(want, k)) FROM w) <= 240),
        r AS (SELECT *, row_number() OVER (PARTITION BY want > level ORDER BY top DESC) AS late, greatest(0, 240 - sum(least(want, level)) OVER ()) AS spare FROM w, v)
        SELECT stratum, CAST(CASE WHEN (SELECT sum(want) FROM w) <= 240 THEN want ELSE least(want, level) + CASE WHEN want > level AND late <= spare THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM r
    """,
    "conv_caps": """
        WITH p AS (SELECT 'group' AS field, source AS value FROM documents UNION SELECT 'problem', lang FROM documents UNION SELECT 'cause', 'c' || doc_id % 7 FROM documents
                   UNION SELECT 'support_focus', 'f' || doc_id % 11 FROM documents UNION SELECT 'strategy', 's' || doc_id % 13 FROM documents UNION SELECT 'strategy', 's' || doc_id % 17 FROM documents),
        n AS (SELECT *, count(*) OVER (PARTITION BY field) AS n FROM p)
        SELECT field, value, CAST(greatest(3, ceil(400 / n * 1.8::DOUBLE)) AS BIGINT) AS cap FROM n WHERE n >= 3 UNION ALL SELECT 'severity', 'high', 48
    """,
    "conv_records": f"""WITH {RECORDS} SELECT stats.conv_id, CAST(count(run) AS INT) AS n_messages, coalesce(string_agg(role, ',' ORDER BY run), '') AS roles, sha256(coalesce(string_agg(content, chr(10) ORDER BY run), '')) AS digest,
        empty_raw_messages, unknown_role_messages, source_system_messages FROM stats LEFT JOIN msgs ON stats.conv_id = msgs.conv_id GROUP BY ALL""",
    "conv_metrics": f"WITH {METRICS} SELECT {_METRIC_NAMES} FROM met",
    "conv_labels": f'WITH {RECORDS}, {LABELS} SELECT conv_id, problem, support_focus, strategies, severity, "group", cause FROM lab',
    "conv_reject_reason": f"WITH {METRICS} SELECT conv_id, coalesce({REASON}, 'kept') AS reason FROM met",
    "conv_reject_counts": f"WITH {METRICS} SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM met GROUP BY 1",
    "conv_label_counts": f"WITH {RECORDS}, {LABELS}, {PAIRS.format('lab')} SELECT field, value, n, total FROM cnt",
    "conv_distribution": f"WITH {RECORDS}, {LABELS} SELECT value, count(*) AS n FROM (SELECT unnest(string_split(strategies, '|')) AS value FROM lab) GROUP BY value ORDER BY n DESC, value LIMIT 3",
    "conv_percentiles": f"WITH {METRICS}, v AS (SELECT unnest(['turn_count', 'characters', 'estimated_tokens']) AS name, unnest([turn_count, characters, estimated_tokens]) AS v FROM met) SELECT name, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 2) AS p{p}" for p in (1, 5, 50, 90, 95, 99)) + " FROM v GROUP BY name",
    "conv_scores": f"""WITH {METRICS}, {LABELS}, ok AS (SELECT met.*, lab.* EXCLUDE (conv_id) FROM met JOIN lab USING (conv_id) WHERE ({REASON}) IS NULL), {PAIRS.format('ok')},
        rar AS (SELECT conv_id, avg(ln((total + 1) / (n + 1) + 1) / ln(total + 1)) AS rarity FROM pairs JOIN cnt USING (field, value) GROUP BY conv_id),
        sc AS (SELECT ok.conv_id, least(30.0, greatest(0.0, 30.0 - low_information_ratio * 12 - repeated_assistant_ratio * 8 - CASE WHEN assistant_mean_chars < 30 THEN 4 ELSE 0 END - least(5, unknown_role_messages) + CASE WHEN high_risk_user AND safety_adequate THEN 1.5 ELSE 0 END)) AS quality,
                      len(string_split(strategies, '|')) AS n, least(20.0, greatest(0.0, 8.0 + 12.0 * coalesce(rarity, 0.25))) AS coverage,
                      CASE WHEN turn_count BETWEEN 6 AND 24 THEN 15.0 WHEN turn_count BETWEEN 4 AND 5 OR turn_count BETWEEN 25 AND 36 THEN 12.0 WHEN turn_count > 36 THEN 8.0 ELSE 7.0 END AS depth,
                      least(10.0, greatest(0.0, 10.0 - CASE WHEN regexp_matches(e, '(###|<\\|end|用户：|助手：|Assistant:|Human:)') THEN 2.0 ELSE 0 END - CASE WHEN len(regexp_extract_all(e, '[A-Za-z]{{12,}}')) > 10 THEN 1.0 ELSE 0 END - least(1.0, source_system_messages * 0.2) - repeated_assistant_ratio * 3)) AS natural_,
                      CASE WHEN estimated_tokens BETWEEN 80 AND 2500 AND abs(estimated_tokens - 600) <= 450 THEN 5.0 WHEN estimated_tokens BETWEEN 80 AND 2500 THEN 4.0 ELSE 2.0 END AS length_ FROM ok LEFT JOIN rar USING (conv_id))
        SELECT conv_id, round(CAST(quality AS DOUBLE), 3) AS quality_score, round(CAST(coverage AS DOUBLE), 3) AS coverage_score,
               round(least(100.0, greatest(0.0, CAST(quality AS DOUBLE) + CASE WHEN n = 1 THEN 12.0 WHEN n <= 4 THEN 17.0 + n * 0.5 ELSE 20.0 END + coverage + depth + natural_ + length_)), 3) AS final_score FROM sc""",
    "conv_chat": f"""WITH {RECORDS} SELECT stats.conv_id, CAST(count(run) + 1 AS INT) AS n, sha256(concat_ws(chr(10), 'Be kind.', string_agg(content, chr(10) ORDER BY run))) AS digest FROM stats LEFT JOIN msgs ON stats.conv_id = msgs.conv_id GROUP BY stats.conv_id""",
}
