"""Review of chunks: status, history, automatic issues, bulk decisions, coverage and readiness.

Statuses are ``pending``, ``approved`` and ``rejected``; whatever else a row says
is mapped to these. Defined cases: null columns count as missing; an unknown id
of a decision is ignored; empty tables give empty results or zeros.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions import text
from tarnweave.operators import ranks
from tarnweave.operators.knowledge import unsafe_detail
from tarnweave.session import settle

STATUSES = ("pending", "approved", "rejected")
# Topics that one person can't pass for a whole source.
SENSITIVE = (
    "self_harm", "suicide", "suicidal_thoughts", "suicidal_plan", "acute_crisis", "harm_to_others", "domestic_violence", "minor_safeguarding",
    "perinatal_crisis", "severe_psychosis", "substance_crisis",
)
REQUIRED = ("chunk_id", "source_id", "title", "target_collection", "content", "official_page_url", "content_sha256", "use_mode", "risk_scope", "population_tags", "topic_tags", "license")


def normal_status(c: Column) -> Column:
    low = F.lower(text.strip(c))
    return F.when(low.isin("approved", "reviewed"), "approved").when(low.isin("rejected", "blocked"), "rejected").otherwise("pending")


def status_rank(c: Column) -> Column:
    return F.when(c == "pending", 0).when(c == "approved", 1).otherwise(2)


def latest_decisions(decisions: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The decision of the highest status of each id (pending, approved, rejected); of equals the last by reviewed_at."""
    order = Window.partitionBy(key).orderBy(F.desc(status_rank(normal_status(F.col("review_status")))), F.desc("reviewed_at"))
    return decisions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply_history(chunks: DataFrame, decisions: DataFrame, key: str = "chunk_id", columns: Sequence[str] = ("review_status", "reviewed_by", "review_comment", "rejection_reason", "reviewed_at")) -> DataFrame:
    """``chunks`` with what the latest decisions say; blank fields of a decision change nothing."""
    named = [c for c in columns if c in decisions.columns]
    d = latest_decisions(decisions, key).select(key, *(F.col(c).alias(f"_{c}") for c in named))
    rows = chunks.join(d, key, "left")
    for c in named:
        given = F.when(~text.is_blank(F.col(f"_{c}").cast("string")), F.col(f"_{c}"))
        rows = rows.withColumn(c, F.coalesce(given, F.col(c)) if c in chunks.columns else given)
    return rows.drop(*(f"_{c}" for c in named))


def blank(rows: DataFrame, name: str) -> Column:
    """Whether a column is missing, null, blank or an empty array."""
    if name not in rows.columns:
        return F.lit(True)
    c = F.col(name)
    return (c.isNull() | (F.size(c) == 0)) if rows.schema[name].dataType.typeName() == "array" else text.is_blank(c.cast("string"))


def high_risk(rows: DataFrame) -> Column:
    """Texts of the safety route, on sensitive topics, or with operational detail."""
    low = lambda n: F.lower(text.text_or_empty(F.col(n)))
    topics = F.coalesce("topic_tags", F.array().cast("array<string>")) if "topic_tags" in rows.columns else F.array().cast("array<string>")
    return (low("target_collection") == "safety") | (low("use_mode") == "safety_only") | (low("risk_scope") == "safety_route_only") | F.arrays_overlap(topics, F.array(*map(F.lit, SENSITIVE))) | unsafe_detail(F.col("content"))


def marked(rows: DataFrame, columns: Sequence[str], markers: Sequence[str]) -> Column:
    """Whether a word of these columns is one of the markers."""
    parts = [F.col(c) if rows.schema[c].dataType.typeName() == "array" else F.array(text.text_or_empty(F.col(c))) for c in columns if c in rows.columns]
    values = F.transform(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)), lambda v: F.lower(text.strip(v)))
    words = F.flatten(F.transform(values, lambda v: F.split(v, r"[\s,;/|，；、\-_]+")))
    return F.arrays_overlap(F.concat(values, words), F.array(*map(F.lit, markers)))


def automatic_issues(rows: DataFrame, required: Sequence[str] = REQUIRED, least: int = 80, most: int = 2500) -> Column:
    """What keeps a chunk from being approved with its source; an empty array if nothing does."""
    n = F.length(text.text_or_empty(F.col("content")))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in rows.columns else F.lit(False)
    rules = [
        *(F.when(blank(rows, c), f"missing:{c}") for c in required), F.when(n < least, "too_short"), F.when(n > most, "too_long"), F.when(unsafe_detail(F.col("content")), "unsafe_operational_detail"),
        F.when(flag("clinical_only") & flag("user_facing"), "clinical_only_marked_user_facing"), F.when(~flag("eligible_for_approval"), "source_not_marked_eligible_for_approval"),
        F.when(high_risk(rows), "requires_chunk_level_high_risk_review"),
    ]
    return F.array_compact(F.array(*rules))


def quality_issues(rows: DataFrame, required: Sequence[str], limit: int | None = 200, id_col: str = "chunk_id") -> DataFrame:
    """(id, issues) of the first ``limit`` rows with an issue, a report; of all of them with ``limit=None``."""
    n = F.length(text.text_or_empty(F.col("content")))
    rules = [*(F.when(blank(rows, c), f"missing:{c}") for c in required), F.when(n < 80, "too_short"), F.when(n > 2500, "too_long"), F.when(F.contains("content", F.lit("�")), "replacement_character"), F.when(unsafe_detail(F.col("content")), "unsafe_operational_detail")]
    found = rows.select(id_col, F.array_compact(F.array(*rules)).alias("issues")).where(F.size("issues") > 0)
    return found if limit is None else found.orderBy(id_col).limit(limit)


def decide(rows: DataFrame, cond: Column, decision: str, reviewed_by: str, comment: str = "", reason: str = "") -> DataFrame:
    """``rows`` with review columns set where ``cond`` holds."""
    if not reviewed_by.strip():
        raise ValueError("a decision needs the name of who made it")
    new = {"review_status": F.lit(decision), "reviewed_by": F.lit(reviewed_by), "review_comment": F.lit(comment), "rejection_reason": F.lit(reason), "reviewed_at": F.current_timestamp()}
    return rows.withColumns({k: F.when(cond, v).otherwise(F.col(k) if k in rows.columns else F.lit(None)) for k, v in new.items()})


def bulk_approve(rows: DataFrame, source_id: str, reviewed_by: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of a source that are pending and have no issue become approved; (rows, one row of counts changed and held)."""
    issues = automatic_issues(rows)
    own = (F.col("source_id") == source_id) & (normal_status(F.col("review_status")) == "pending")
    ok = own & (F.size(issues) == 0)
    counts = rows.agg(F.count_if(ok).alias("changed"), F.count_if(own & (F.size(issues) > 0)).alias("held"))
    return decide(rows, ok, "approved", reviewed_by), counts


def eligibility(rows: DataFrame, collections: Sequence[str]) -> Column:
    """struct(eligible, reason): the first rule that holds a chunk back from its route."""
    low = lambda n: F.lower(text.text_or_empty(F.col(n)))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in rows.columns else F.lit(False)
    reason = (
        F.when(normal_status(F.col("review_status")) == "rejected", "already_rejected").when(flag("exclude_from_index"), "excluded_from_index")
        .when(~low("target_collection").isin(*collections), "collection_not_in_scope").when(blank(rows, "content"), "empty_content").when(blank(rows, "official_page_url"), "missing_official_url")
        .when(blank(rows, "license"), "missing_license").when(unsafe_detail(F.col("content")), "unsafe_operational_detail").when(flag("clinical_only") & flag("user_facing"), "clinical_only_user_facing")
        .when(F.length("content") < 80, "too_short").when(F.length("content") > 2500, "too_long").otherwise("eligible")
    )
    return F.struct((reason == "eligible").alias("eligible"), reason.alias("reason"))


def status_change(before: DataFrame, after: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(collection, before, after, n): how many chunks went from one status to another."""
    b = before.select(key, F.col("target_collection").alias("collection"), normal_status(F.col("review_status")).alias("before"))
    return b.join(after.select(key, normal_status(F.col("review_status")).alias("after")), key).groupBy("collection", "before", "after").agg(F.count("*").alias("n"))


def diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(field, changed, filled): rows that differ in each field, and those that had none before."""
    old = before.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    rows = after.join(old, key)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), (~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias("changed"), (text.is_blank(F.col(f"_{c}").cast("string")) & ~text.is_blank(F.col(c).cast("string"))).alias("filled")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field").agg(F.count_if("p.changed").alias("changed"), F.count_if("p.filled").alias("filled"))


def source_summary(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A row per source: chunks, eligible, held, high-risk, and a map of statuses; sources without chunks have zeros."""
    own = rows.select("source_id", (F.size(automatic_issues(rows)) == 0).alias("ok"), high_risk(rows).alias("risk"), normal_status(F.col("review_status")).alias("status"))
    counts = own.groupBy("source_id").agg(
        F.count("*").alias("chunk_count"), F.count_if("ok").alias("eligible"), F.count_if(~F.col("ok")).alias("held"), F.count_if("risk").alias("high_risk_chunks"),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
    )
    if sources is not None:
        counts = sources.join(counts, "source_id", "left").fillna(0, ["chunk_count", "eligible", "held", "high_risk_chunks", *STATUSES])
    return counts


def source_balance(rows: DataFrame) -> DataFrame:
    """(source_id, n, share), the largest first."""
    counts = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("source_id", "n", F.round(F.col("n") / F.col("total"), 4).alias("share")).orderBy(F.desc("n"), "source_id")


def completeness(rows: DataFrame, collections: DataFrame, key: str = "target_collection") -> DataFrame:
    """(collection, n, state) of every declared collection, those without rows too."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return collections.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("ready").alias("state"))


def tag_coverage(rows: DataFrame, labels: DataFrame, tags: str = "topic_tags", source: str = "source_id", chinese: str = "zh") -> DataFrame:
    """(label, sources, chunks, native, rating) of every wanted label."""
    tagged = rows.select(source, "language", F.explode(F.array_distinct(tags)).alias("label"))
    found = tagged.groupBy("label").agg(F.count_distinct(source).alias("sources"), F.count("*").alias("chunks"), F.count_if(F.lower("language").startswith(chinese)).alias("native"))
    wanted = labels.join(found, "label", "left").fillna(0, ["sources", "chunks", "native"])
    return wanted.withColumn("rating", rating(F.col("sources"), F.col("chunks"), F.col("native")))


def rating(sources: Column, chunks: Column, native: Column) -> Column:
    weak = F.when(native > 0, "Adequate").otherwise("Weak")
    return F.when((sources >= 3) & (chunks >= 12), "Strong").when((sources >= 2) & (chunks >= 5), "Adequate").when((sources >= 1) & (chunks >= 1), weak).otherwise("Missing")


def topic_share(rows: DataFrame, core: Sequence[str], tags: str = "topic_tags") -> DataFrame:
    """(covered, missing, share) of the core topics; the topics of all rows meet as a set of core topics only."""
    wanted = F.array(*map(F.lit, sorted(core)))
    seen = rows.select(F.explode(F.array_intersect(tags, wanted)).alias("t")).agg(F.array_sort(F.collect_set("t")).alias("covered"))
    return seen.select("covered", F.array_except(wanted, F.col("covered")).alias("missing"), F.round(F.size("covered") / max(len(core), 1), 4).alias("share"))


def missing_metadata(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, missing): rows without a value, counted in one pass."""
    counts = rows.agg(*(F.count_if(blank(rows, c)).alias(c) for c in columns))
    return counts.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("field", "missing"))


def readiness(checks: Mapping[str, Column], rows: DataFrame) -> DataFrame:
    """(passed, blockers): aggregate conditions over a table, and the names of those that fail."""
    names = list(checks)
    agg = rows.agg(*(F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate(checks.values())))
    blockers = F.array_compact(F.array(*(F.when(~F.col(f"_{i}"), n) for i, n in enumerate(names))))
    return agg.select((F.size(blockers) == 0).alias("passed"), blockers.alias("blockers"))


def duplicate_content(rows: DataFrame, key: str = "content_sha256", id_col: str = "chunk_id", source: str = "source_id", limit: int = 50, shown: int = 10) -> DataFrame:
    """The most repeated contents: count, the first ids, the sources. A report of ``limit`` rows.

    Counts come first, so only the ids of the reported contents are looked up,
    and of each only the smallest are kept by rank.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(limit)
    own = rows.join(F.broadcast(counts), key)
    first = own.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(id_col))).where(F.col("_k") <= shown)
    ids = first.groupBy(key, "n").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    sources = own.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return ids.join(sources, key).orderBy(F.desc("n"), key)


def char_stats(rows: DataFrame, column: str = "char_count") -> DataFrame:
    """(mean, median, p95) of lengths, p95 at place int(n * 0.95) of the sorted values, counted from one."""
    n = F.count(column)
    middle = (n - 1) / 2
    at = F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in (("low", F.floor(middle)), ("high", F.ceil(middle)), ("p95", F.greatest(F.lit(1), F.floor(n * 0.95)) - 1))))
    whole = settle(rows.agg(F.round(F.avg(column), 2).alias("mean"), at.alias("at")), "lengths")
    found = ranks.values_at(rows, column, whole.select(F.explode("at").alias("x")).select("x.*"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    places = found.agg(((of("low") + of("high")) / 2).alias("median"), of("p95").cast(rows.schema[column].dataType).alias("p95"))
    return whole.select("mean").join(F.broadcast(places))  # one row each


def queues(rows: DataFrame, flags: Mapping[str, Column], rest: str) -> DataFrame:
    """``rows`` with queues: the names of the (overlapping) buckets whose condition holds, or the rest's."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items())))
    return rows.withColumn("queues", F.when(F.size(names) == 0, F.array(F.lit(rest))).otherwise(names))


def merge_registry(base: DataFrame, added: DataFrame, key: str = "source_id", keep: Sequence[str] = ("download", "auto_download"), rejected: str = "rejected") -> DataFrame:
    """Sources of both lists; the added one's values win but for ``keep``; rejected ones go."""
    cols = [c for c in dict.fromkeys([*base.columns, *added.columns]) if c != key]
    b = base.select(key, *(F.col(c).alias(f"b_{c}") for c in base.columns if c != key))
    a = added.select(key, *(F.col(c).alias(f"a_{c}") for c in added.columns if c != key))
    rows = a.join(b, key, "full_outer")
    pick = lambda c: F.coalesce(*(F.col(n) for n in ((f"b_{c}", f"a_{c}") if c in keep else (f"a_{c}", f"b_{c}")) if n in rows.columns))
    merged = rows.select(key, *(pick(c).alias(c) for c in cols))
    return merged.where(F.coalesce(F.col("decision"), F.lit("")) != rejected) if "decision" in cols else merged


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def source_with_chunks(sources: DataFrame, chunks: DataFrame, key: str = "source_id", order: str = "chunk_index", columns: Sequence[str] = ("chunk_id", "section", "content")) -> DataFrame:
    """Each source with its chunks in order, as an array of struct(order, columns). A source is a document: its chunks fit one row."""
    nested = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("chunks"))
    none = F.array().cast(nested.schema["chunks"].dataType)
    return sources.join(nested, key, "left").withColumn("chunks", F.coalesce("chunks", none))


def lowest_selected(selected: DataFrame, score: str = "final_score", id_col: str = "source_id", most: int = 100) -> DataFrame:
    """The ``most`` selected rows of the least score, for a person to look at."""
    return selected.orderBy(score, id_col).limit(most)


def manual_rows(candidates: DataFrame) -> DataFrame:
    """What a person must fetch or look at: candidates that can't be downloaded by themselves, with a priority by their score."""
    flag = lambda c, d: F.coalesce(F.col(c).cast("boolean"), F.lit(d))
    alone = flag("downloadable", False) & flag("auto_download", True) & ~F.col("decision").eqNullSafe("manual_review")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return candidates.where(~alone).select(
        "title", F.col("organization").alias("source"), "official_url", F.coalesce("decision_reason", F.lit("")).alias("why_useful"), joined("population").alias("population"), joined("topics").alias("topic"),
        F.coalesce("license", F.lit("")).alias("license"), F.lit("manual_review_or_manual_download").alias("access_type"), F.when(F.coalesce("source_quality_score", F.lit(0)) >= 65, "P1").otherwise("P2").alias("priority"),
    )
