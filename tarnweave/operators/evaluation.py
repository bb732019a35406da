"""Evaluation: ranking, classification, safety, latency and rubric scores of many cases at once.

Defined cases: denominators of zero give 0; null predictions are a label of their
own, ``none``; empty tables give empty results or zeros.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions import numbers, text


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def retrieval_rows(results: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row a query: hit, precision and nDCG at each k, reciprocal rank, cited, n_relevant, n_found.

    ``results``: (query_id, rank, source_id); ``relevant``: (query_id, source_id),
    with a null source_id for a query that has none. A source counts once for gain.
    """
    truth = relevant.groupBy("query_id").agg(F.array_distinct(F.collect_list("source_id")).alias("truth"))
    found = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda r: r["source_id"]).alias("found"))
    rows = truth.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.expr("slice(truth, 1, 0)")))
    hit = F.transform("found", lambda s, i: F.array_contains("truth", s) & (F.array_position("found", s) == i + 1))
    rows = rows.withColumns({"hits": hit, "n_relevant": F.size("truth"), "n_found": F.size("found")})
    first = F.array_position("hits", F.lit(True))
    dcg = lambda arr: F.aggregate(F.transform(arr, lambda h, i: F.when(h, 1.0 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
    ideal = lambda k: F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)))), lambda i: 1.0 / F.log2(i + 1)), F.lit(0.0), lambda t, x: t + x)
    at = {}
    for k in ks:
        top = F.slice("hits", 1, k)
        n = F.size(F.filter(top, lambda h: h))
        at |= {f"hit_{k}": (n > 0).cast("int"), f"precision_{k}": n / F.greatest(F.lit(1), F.least(F.col("n_found"), F.lit(k))), f"ndcg_{k}": F.when(F.col("n_relevant") > 0, dcg(top) / ideal(k)).otherwise(0.0)}
    return rows.select("query_id", "n_relevant", "n_found", F.when(first > 0, 1.0 / first).otherwise(0.0).alias("rr"), (first > 0).cast("int").alias("cited"), *(c.alias(n) for n, c in at.items()))


def retrieval_report(rows: DataFrame, ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = ()) -> DataFrame:
    """Means over queries: recall, nDCG, MRR and citation over those with relevant sources, precision over all, rejections over those without."""
    some, none = F.count_if(F.col("n_relevant") > 0), F.count_if(F.col("n_relevant") == 0)
    own = lambda c: F.sum(F.when(F.col("n_relevant") > 0, F.col(c)).otherwise(0.0))
    aggs = [F.count("*").alias("query_count")]
    for k in ks:
        aggs += [ratio(own(f"hit_{k}"), some).alias(f"recall_{k}"), ratio(own(f"precision_{k}"), F.count("*")).alias(f"precision_{k}"), ratio(own(f"ndcg_{k}"), some).alias(f"ndcg_{k}")]
    aggs += [ratio(own("rr"), some).alias("mrr"), ratio(own("cited"), some).alias("source_citation_accuracy")]
    aggs += [ratio(F.count_if((F.col("n_relevant") == 0) & (F.col("n_found") > 0)), none).alias("irrelevant_retrieval_rate"), ratio(F.count_if((F.col("n_relevant") == 0) & (F.col("n_found") == 0)), none).alias("correct_rejection_rate")]
    return rows.groupBy(*by).agg(*aggs)


def fuzzy_tag(candidate: Column, expected: Column) -> Column:
    """Equal, or one within the other and both of at least five characters."""
    inside = (F.length(candidate) >= 5) & (F.length(expected) >= 5) & (F.contains(candidate, expected) | F.contains(expected, candidate))
    return (candidate != "") & (expected != "") & ((candidate == expected) | inside)


def case_relevance(topics: Column, source: Column, title: Column, section: Column, content: Column, expected_topics: Column, expected_sources: Column) -> Column:
    """Whether a result serves a case: by source, by topic tag, or by a topic's words in title, section or the first 600 characters."""
    hay = F.lower(F.concat_ws(" ", title, section, F.substring(content, 1, 600)))
    by_topic = F.exists(topics, lambda t: F.exists(expected_topics, lambda e: fuzzy_tag(t, e)))
    by_words = F.exists(expected_topics, lambda e: (F.length(e) >= 4) & F.contains(hay, F.replace(e, F.lit("_"), F.lit(" "))))
    return F.array_contains(expected_sources, source) | by_topic | by_words


def ranking_rows(results: DataFrame, cases: DataFrame, depth: int = 5, ks: Sequence[int] = (1, 3, 5), by: str = "method") -> DataFrame:
    """Per case and method: hit, topic recall, topic and source hit at each k, MRR and nDCG at ``depth``, no_result.

    ``results``: (case_id, method, rank, source_id, topics, relevant); ``cases``:
    (case_id, method, expected_topics, expected_sources).
    """
    own = results.where(F.col("rank") <= depth)
    aggs = [F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if("relevant").alias("n_hit"), F.count("*").alias("n")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.max((inside & F.col("relevant")).cast("int")).alias(f"h{k}"), F.flatten(F.collect_list(F.when(inside, F.col("topics")))).alias(f"t{k}"), F.collect_set(F.when(inside, F.col("source_id"))).alias(f"s{k}")]
    rows = cases.join(own.groupBy("case_id", by).agg(*aggs), ["case_id", by], "left")
    none = F.array().cast("array<string>")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce("n_hit", F.lit(1)).cast("int"))), lambda i: 1.0 / F.log2(i + 1)), F.lit(0.0), lambda t, x: t + x)
    out = {"mrr_at_5": F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4), "ndcg_at_5": F.round(F.when(F.coalesce("n_hit", F.lit(0)) > 0, F.col("dcg") / ideal).otherwise(0.0), 4), "no_result": F.coalesce("n", F.lit(0)) == 0}
    for k in ks:
        topics, sources = F.coalesce(f"t{k}", none), F.coalesce(F.col(f"s{k}").cast("array<string>"), none)
        matched = F.size(F.filter("expected_topics", lambda e: F.exists(topics, lambda t: fuzzy_tag(t, e))))
        hit = F.coalesce(f"h{k}", F.lit(0)) == 1
        wanted = F.size("expected_topics") > 0
        out |= {f"hit_at_{k}": hit, f"recall_at_{k}": F.round(F.when(wanted, matched / F.greatest(F.size("expected_topics"), F.lit(1))).otherwise(hit.cast("double")), 4)}
        out |= {f"topic_hit_at_{k}": F.when(wanted, matched > 0), f"source_hit_at_{k}": F.when(F.size("expected_sources") > 0, F.arrays_overlap(F.col("expected_sources"), sources))}
    return rows.select("case_id", by, *(c.alias(n) for n, c in out.items()))


def guardrail_rows(results: DataFrame, depth: int = 5, by: Sequence[str] = ("case_id", "method")) -> DataFrame:
    """Rates of wrong population, wrong mode, leaked safety texts, duplicates and language among the first ``depth`` results.

    ``results`` has rank, compatible (null: not checked), mode_expected, leaks, content_key and language_hit (null: no wish).
    """
    top = results.where(F.col("rank") <= depth)
    r = lambda x: F.round(x, 4)
    n = F.count("*")
    return top.groupBy(*by).agg(
        r(F.count_if(~F.col("compatible")) / F.greatest(F.count("compatible"), F.lit(1))).alias("wrong_population_retrieval_rate"),
        r(F.count_if(~F.col("mode_expected")) / n).alias("wrong_use_mode_retrieval_rate"), r(F.count_if("leaks") / n).alias("safety_leakage_rate"),
        r((n - F.count_distinct("content_key")) / n).alias("duplicate_retrieval_rate"),
        r(F.when(F.count("language_hit") > 0, F.count_if("language_hit") / F.count("language_hit"))).alias("language_preference_accuracy"),
    )


def failure_codes(method: Column, no_result: Column, hit: Column, other_hit: Column, guard: Mapping[str, Column], longest: Column) -> Column:
    """Why a case failed with a method, in a fixed order; ``OK`` if it didn't."""
    miss = F.when(method == "bm25", "BM25_TOKENIZATION_FAILURE").when(method == "dense", "DENSE_SEMANTIC_FAILURE").when(other_hit, "RRF_FUSION_FAILURE").otherwise("WRONG_TOPIC")
    codes = F.array_compact(F.array(
        F.when(no_result, "NO_RELEVANT_SOURCE"), F.when(~hit, miss), F.when(guard["population"] > 0, "WRONG_POPULATION"), F.when(guard["mode"] > 0, "USE_MODE_FILTER_FAILURE"),
        F.when(guard["leak"] > 0, "SAFETY_LEAKAGE"), F.when(guard["duplicate"] >= 0.2, "TOO_MANY_DUPLICATES"), F.when(longest < 80, "CHUNK_TOO_SMALL"),
    ))
    return F.when(F.size(codes) == 0, F.array(F.lit("OK"))).otherwise(codes)


def macro_means(rows: DataFrame, metrics: Sequence[str], by: str = "method", digits: int = 4) -> DataFrame:
    """(by, metric, value): means that pass over nulls."""
    long = rows.select(by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(by, "x.*")
    return long.groupBy(by, "metric").agg(F.round(F.avg("v"), digits).alias("value"))


def value_counts(rows: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """(dimension, value, n): counts of several columns in one pass; arrays count each value."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}

    def of(c: str) -> Column:
        values = F.col(c) if kinds[c] == "array" else F.array(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("dimension"), v.cast("string").alias("value")))

    pairs = [of(c) for c in columns]
    counts = rows.select(F.explode(F.concat(*pairs)).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    if top is None:
        return counts
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).drop("_k")


def confusion(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return rows.groupBy(name(expected).alias("expected"), name(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def label_report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion table, over the labels of both columns."""
    sides = counts.select("n", (F.col("expected") == F.col("predicted")).alias("ok"), F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(True).alias("truth")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("truth")))).alias("s"))
    sums = sides.groupBy("s.label").agg(F.sum(F.when(F.col("ok") & F.col("s.truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.truth"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("s.truth"), F.col("n")).otherwise(0)).alias("said"))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def classification_report(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1, n)."""
    counts = confusion(rows, expected, predicted)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)).alias("ok"))
    macro = label_report(counts).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return F.broadcast(macro).join(total).select(ratio(F.col("ok"), F.col("n")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", "n")


def _high(column: str, high: str) -> Column:
    return F.coalesce(F.col(column) == high, F.lit(False))


def safety_report(rows: DataFrame, high: str = "high") -> DataFrame:
    """Recall, precision and misses of the high class, and how negated and reported cases fare.

    ``rows``: (case_id, expected, predicted, negated_expected, negated_predicted,
    third_party_expected, third_party_predicted). The ids are in ``safety_misses``.
    """
    e, p = _high("expected", high), _high("predicted", high)
    kept = lambda a, b: ratio(F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a)))
    return rows.agg(
        ratio(F.count_if(e & p), F.count_if(e)).alias("high_risk_recall"), ratio(F.count_if(e & p), F.count_if(p)).alias("high_risk_precision"),
        F.count_if(e & ~p).alias("high_risk_false_negative_count"), F.count_if(~e & p).alias("high_risk_false_positive_count"),
        kept("negated_expected", "negated_predicted").alias("negation_accuracy"), kept("third_party_expected", "third_party_predicted").alias("third_party_accuracy"),
    )


def safety_misses(rows: DataFrame, high: str = "high") -> DataFrame:
    """(case_id, kind): every ``missed_high_risk`` and ``false_positive`` case of the report, one row each."""
    e, p = _high("expected", high), _high("predicted", high)
    return rows.where(e != p).select("case_id", F.when(e, "missed_high_risk").otherwise("false_positive").alias("kind"))


def latency_report(rows: DataFrame, duration: str = "total_duration_ms", success: str = "success", by: Sequence[str] = ()) -> DataFrame:
    """Request count, mean, median and nearest-rank p95 of whole milliseconds, and the share of successes.

    The p95 comes from counts of distinct durations, so no group's rows are gathered.
    """
    ms = F.coalesce(F.col(duration), F.lit(0)).cast("long")
    counts = rows.groupBy(*by, ms.alias("ms")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(success), F.lit(True))).alias("ok"))
    order = Window.partitionBy(*by, F.lit(1)).orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, F.lit(1))
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(whole))
    place = lambda share: F.min(F.when(F.col("upto") > F.rint((F.col("all") - 1) * share), F.col("ms")))
    low, high = F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) / 2), F.col("ms"))), F.min(F.when(F.col("upto") > F.ceil((F.col("all") - 1) / 2), F.col("ms")))
    return counts.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("request_count"), F.round(F.sum(F.col("ms") * F.col("n")) / F.sum("n"), 2).alias("average_latency_ms"),
        F.floor((low + high) / 2).cast("long").alias("p50_latency_ms"), place(0.95).alias("p95_latency_ms"), (F.sum("ok") / F.sum("n")).alias("success_rate"),
    )


def score_summary(scores: DataFrame, by: Sequence[str] = ("framework_id", "metric_name"), value: str = "score") -> DataFrame:
    """Mean, median, population deviation (0 for one value) and count of each metric."""
    return scores.groupBy(*by).agg(F.round(F.avg(value), 3).alias("mean"), F.round(F.median(value), 3).alias("median"), F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), 3).alias("std"), F.count(value).alias("n"))


def metric_delta(candidate: DataFrame, baseline: DataFrame, by: Sequence[str] = ("framework_id", "metric_name")) -> DataFrame:
    """(by, candidate_mean, baseline_mean, delta) of the metrics that both runs have."""
    side = lambda df, name: df.select(*by, F.col("mean").alias(name))
    return side(candidate, "candidate_mean").join(side(baseline, "baseline_mean"), list(by)).withColumn("delta", F.round(F.col("candidate_mean") - F.col("baseline_mean"), 3))


def presence(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a text contains."""
    return reduce(lambda a, b: a + b, (F.contains(text.text_or_empty(c), F.lit(t)).cast("int") for t in terms), F.lit(0))


def clip(c: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.round(numbers.clamp(c, low, high), 2)


def length_score(c: Column) -> Column:
    n = F.length(text.strip(c))
    return F.when(n < 35, 2.0).when(n.between(70, 420), 4.2).when(n <= 560, 3.8).otherwise(3.0)


def rubric(reply: Column, terms: Mapping[str, Sequence[str]], has_cause: Column, has_sources: Column, has_state: Column, has_emotion: Column, has_needs: Column, has_plan: Column, crisis: Column, known_tag: Column) -> dict[str, Column]:
    """The 27 heuristic metrics of a reply by name; ``terms`` has empathy, reflection, question, action, unsafe, toxic, crisis, person, source and hedge."""
    n = {k: presence(reply, v) for k, v in terms.items()}
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    empathy = clip(2.2 + n["empathy"] * 0.55 + n["reflection"] * 0.25)
    specificity = clip(2.2 + flag(known_tag, 0.35) + flag(has_cause, 0.5) + flag(n["action"] > 0, 0.5) + flag(has_sources, 0.35))
    safety = clip(F.when(crisis, F.when(n["crisis"] >= 2, 4.7).otherwise(2.0)).otherwise(4.6 - n["unsafe"] * 1.1))
    information = clip(2.6 + flag(has_sources, 0.85) + flag(n["source"] > 0, 0.35) + flag(n["hedge"] > 0, 0.25))
    fluency, probing = length_score(reply), clip(2.4 + F.least(n["question"], F.lit(2)) * 0.7)
    authentic = clip(2.5 + flag(n["person"] > 0, 0.6) + empathy * 0.25)
    mean = lambda *cs: clip(reduce(lambda a, b: a + b, cs) / len(cs))
    out = {
        "WAI Goal": specificity, "WAI Task": mean(specificity, information), "WAI Bond": empathy, "BLRI Cognitive Empathy": mean(empathy, specificity), "BLRI Affective Empathy": empathy,
        "BLRI Differentiated Empathy": clip(2.2 + flag(has_state, 0.8) + flag(has_emotion, 0.4)), "BLRI Inner Pattern": clip(2.1 + flag(has_needs, 0.9) + flag(has_plan, 0.4)),
        "CCS-R Probing": probing, "CCS-R Therapeutic Environment": safety, "CCS-R Reflecting": clip(2.2 + n["reflection"] * 0.6), "CCS-R Change Facilitation": clip(2.2 + n["action"] * 0.45),
        "Fluency": fluency, "Expression": mean(fluency, empathy), "Empathy": empathy, "Information": information, "Humanoid": authentic, "Skillful": mean(specificity, safety, information),
        "Comprehensiveness": mean(empathy, specificity, information), "Professionalism": clip(safety * 0.55 + information * 0.25 + 1.0), "Authenticity": authentic, "Safety": safety,
        "Overall Quality": mean(empathy, specificity, safety, information), "Specificity": specificity, "Medical Advice": F.round(F.least(n["unsafe"] * 1.5, F.lit(5.0)), 2),
        "Factual Consistency": clip(3.0 + flag(has_sources, 0.7) - n["unsafe"] * 0.7), "Toxicity": F.round(F.least(n["toxic"] * 1.25, F.lit(5.0)), 2),
    }
    return out | {"Overall": mean(*(out[k] for k in ("Fluency", "Expression", "Empathy", "Information", "Humanoid", "Skillful")))}


def flag_rates(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """The share of rows with each flag."""
    return rows.agg(*(F.coalesce(F.avg(F.col(f).cast("int")), F.lit(0.0)).alias(f) for f in flags))


def suite_union(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several suites under their names."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("suite", F.lit(n)) for n, df in parts.items()))


def table_digest(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, digest): a digest that doesn't depend on order: the sum of row hashes and of a second family, hashed.

    A sorted concatenation would gather the table in one task.
    """
    own = F.to_json(F.struct(*(columns or sorted(rows.columns))))
    one, two = F.xxhash64(own).cast("decimal(38,0)"), F.xxhash64(F.lit("second"), own).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(one).cast("string"), F.sum(two).cast("string")), 256).alias("digest"))


def interval_accuracy(rows: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """(n, accuracy): the share of values within their intervals."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col(value).between(F.col(low), F.col(high)).cast("int")), F.lit(0.0)).alias("accuracy"))


def sampled(rows: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows by the hash of their id and a seed: the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)


def numbered_cases(topics: DataFrame, prefix: str, topic: str = "topic", messages: str = "messages") -> DataFrame:
    """(case_id, topic, message): one case a message, numbered through the topics in their order."""
    rows = topics.select("place", topic, F.posexplode(messages).alias("no", "message"))
    number = F.row_number().over(Window.orderBy("place", "no"))  # cases that people write, a few hundred
    return rows.select(F.concat(F.lit(prefix), F.format_string("%03d", number)).alias("case_id"), topic, "message")


def crossed_cases(scenarios: DataFrame, repeats: int, prefix: str) -> DataFrame:
    """(case_id, repeat, ...): every scenario ``repeats`` times, numbered by repeat and place."""
    rows = scenarios.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return rows.withColumn("case_id", F.concat(F.lit(prefix), F.format_string("%04d", F.row_number().over(Window.orderBy("repeat", "place")))))


def freeze(cases: DataFrame, path: str, expected: int) -> DataFrame:
    """Write a benchmark as JSON lines after its size was checked; its digest is returned."""
    if (n := cases.count()) != expected:
        raise ValueError(f"{expected} cases expected, {n} found")
    cases.write.mode("overwrite").json(path)
    return table_digest(cases)
