"""Rule classifiers over texts as columns: risk, emotion, cause, state, strategy, route.

The lexicons are parameters; a lexicon is a mapping from label to terms, kept
by people and small. What is here is how they are weighed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions import numbers, text

# What negates a term that follows.
NEGATIONS = ("没有", "没", "并不", "不是", "不")


def _terms(terms: Sequence[str]) -> Column:
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def _found(c: Column, term: Column) -> Column:
    return F.contains(c, F.lower(term))


def negated(c: Column, term: Column, reach: int = 8, words: Sequence[str] = NEGATIONS, phrases: Sequence[str] = (), before: Sequence[str] = NEGATIONS[:3]) -> Column:
    """Whether the first occurrence of a term is negated: right before it, by a word within reach, or by a phrase around it."""
    window = text.near_place(c, term, reach, reach)
    left = F.substring(window, 1, reach)
    direct = reduce(lambda a, b: a | b, (F.contains(window, F.concat(F.lit(w), term)) for w in words), F.lit(False))
    near = reduce(lambda a, b: a | b, (F.contains(left, F.lit(w)) for w in before), F.lit(False))
    said = reduce(lambda a, b: a | b, (F.contains(window, F.lit(p)) for p in phrases), F.lit(False))
    return _found(c, term) & (direct | near | said)


def unnegated_terms(c: Column, terms: Sequence[str], **how) -> Column:
    low = F.lower(text.text_or_empty(c))
    return F.filter(_terms([t.lower() for t in terms]), lambda t: _found(low, t) & ~negated(low, t, **how))


def evidence(c: Column, terms: Column, around: int = 30) -> Column:
    """The text around the first of the terms that occurs; null if none does."""
    low = F.lower(text.text_or_empty(c))
    first = F.get(F.filter(terms, lambda t: _found(low, t)), F.lit(0))
    at = F.call_function("instr", low, F.lower(first))
    start = F.greatest(F.lit(1), at - around)
    return F.when(first.isNotNull(), F.substring(text.text_or_empty(c), start, at - start + F.length(first) + around))


def _once(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of the values, which are computed once a row however often ``f`` names them, in lambdas too."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f), F.lit(0))


@dataclass(frozen=True)
class RiskLexicon:
    high: tuple[str, ...]
    medium: tuple[str, ...] = ()
    report: tuple[str, ...] = ()
    fiction: tuple[str, ...] = ()
    intent: tuple[str, ...] = ()
    plan: tuple[str, ...] = ()
    time: tuple[str, ...] = ()
    means: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    negations: tuple[str, ...] = NEGATIONS
    near_negations: tuple[str, ...] = NEGATIONS[:3]
    #: Terms that only these phrases deny, wherever in the text they are.
    denials: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def reported(c: Column, lex: RiskLexicon) -> Column:
    """Whether a text tells of someone else, or of fiction, and states no intent of its own."""
    return text.contains_any(c, lex.report) & (text.contains_any(c, lex.fiction) | ~text.contains_any(c, lex.intent))


def assess_risk(sources: Mapping[str, Column], lex: RiskLexicon) -> Column:
    """struct(level, action, context, matched_terms, matched_sources, dimensions, evidence) over several texts of a row.

    High terms that aren't negated decide; where all texts that have one tell of
    others, the level is medium; medium terms come next, and denied high terms
    say something only where neither is: beside a medium term nothing counts as
    negated, so that a threat to others isn't lost.
    """
    body = F.array_join(F.filter(F.array(*(text.strip(c) for c in sources.values())), lambda t: t != ""), "\n")
    named = F.array(*(F.struct(F.lit(n).alias("source"), text.strip(c).alias("content"), F.lower(text.strip(c)).alias("low"), reported(c, lex).alias("reported")) for n, c in sources.items()))
    return _once(lambda x: _once(lambda y: _assessed(y, lex), body=x["body"], low=x["low"], named=x["named"], marked=_marked(x["low"], lex)), body=body, low=F.lower(body), named=named)


def _marked(low: Column, lex: RiskLexicon) -> Column:
    """The high terms in a text, each with whether it is denied."""
    how = {"words": lex.negations, "phrases": lex.phrases, "before": lex.near_negations}

    def deny(t: Column) -> Column:
        usual = negated(low, F.lower(t), **how)
        own = [F.when(t == term, text.contains_any(low, phrases)) for term, phrases in lex.denials.items()]
        return F.coalesce(*own, usual) if own else usual

    return F.transform(F.filter(_terms(lex.high), lambda t: _found(low, t)), lambda t: F.struct(t.alias("term"), deny(t).alias("denied")))


def _assessed(x: Column, lex: RiskLexicon) -> Column:
    of = lambda denied: F.transform(F.filter(x["marked"], lambda m: m["denied"] if denied else ~m["denied"]), lambda m: m["term"])
    medium = F.filter(_terms(lex.medium), lambda t: F.contains(x["body"], t))
    return _once(lambda y: _judged(x, y["hits"], y["denied"], y["medium"], lex), hits=of(False), denied=of(True), medium=medium)


def _judged(x: Column, hits: Column, denied: Column, medium: Column, lex: RiskLexicon) -> Column:
    low, named = x["low"], x["named"]
    by = lambda terms: F.filter(named, lambda s: F.exists(terms, lambda t: _found(s["low"], t)))
    told = F.forall(by(hits), lambda s: s["reported"])
    high, mid = F.size(hits) > 0, F.size(medium) > 0
    no = ~high & ~mid & (F.size(denied) > 0)
    terms = F.when(high, hits).when(mid, medium).otherwise(F.array().cast("array<string>"))
    has = lambda group: text.contains_any(low, group)
    dimensions = F.struct(
        high.alias("ideation"), (high & has(lex.plan)).alias("plan"), (high & has(lex.time)).alias("timeframe_present"),
        F.when(~high, "none").when(has(lex.means), "present").otherwise("unknown").alias("means_access"),
        F.when(high & has(lex.time), "high").when(high, "medium").otherwise("low").alias("immediacy"),
        (has(lex.others) & ~no).alias("harm_to_others"), no.alias("negated"), (high & told).alias("third_party_report"),
    )
    level = F.when(high & told, "medium").when(high, "high").when(mid, "medium").otherwise("low")
    shown = F.when(high, hits).when(mid, medium).otherwise(denied)
    snippets = F.filter(F.transform(by(shown), lambda s: F.struct(s["source"].alias("source"), evidence(s["content"], shown).alias("content"))), lambda e: e["content"].isNotNull())
    return F.struct(
        level.alias("level"), F.when(level == "high", "crisis_referral").when(level == "medium", "support_with_monitoring").otherwise("normal_support").alias("action"),
        F.when(high & told, "reported_or_quoted").when(no, "negated_high_risk").otherwise("none").alias("context"),
        terms.alias("matched_terms"), F.transform(by(terms), lambda s: s["source"]).alias("matched_sources"), dimensions.alias("dimensions"), snippets.alias("evidence"),
    )


def best_label(c: Column, lexicon: Mapping[str, Sequence[str]], default: str) -> Column:
    """struct(label, evidence, confidence): the label with most terms, then with the longest; of equals the first."""
    low = F.lower(text.text_or_empty(c))

    def scored(place: int, label: str, terms: Sequence[str]) -> Column:
        found = F.filter(_terms(terms), lambda t: _found(low, t))
        size = F.aggregate(found, F.lit(0), lambda n, t: n + F.length(t))
        return F.struct(F.size(found).alias("n"), size.alias("size"), F.lit(-place).alias("place"), F.lit(label).alias("label"), F.slice(found, 1, 5).alias("evidence"))

    best = F.array_max(F.array(*(scored(i, k, v) for i, (k, v) in enumerate(lexicon.items()))))
    hit = best["n"] > 0
    confidence = F.when(hit, F.round(F.least(F.lit(0.58) + best["n"] * 0.12, F.lit(0.9)), 2)).otherwise(0.35)
    return F.struct(F.when(hit, best["label"]).otherwise(default).alias("label"), F.when(hit, best["evidence"]).otherwise(F.array().cast("array<string>")).alias("evidence"), confidence.alias("confidence"))


# Valence, arousal and control of the emotions.
DIMENSIONS = {
    "joy": (0.72, 0.55, 0.68), "anxiety": (-0.62, 0.78, 0.28), "sadness": (-0.72, 0.28, 0.34), "anger": (-0.58, 0.82, 0.32), "fatigue": (-0.42, 0.2, 0.44),
    "loneliness": (-0.66, 0.26, 0.38), "stress": (-0.52, 0.72, 0.36), "mixed": (-0.18, 0.58, 0.42), "neutral": (0.0, 0.35, 0.55),
}


def emotion_dimensions(label: Column, intensity: Column, stress: Column | None = None, visual: Column | None = None) -> Column:
    """struct of valence, arousal, control and intensity, each (score, label); ``stress`` is from 0 to 10, ``visual`` a confidence."""
    pick = lambda i: reduce(lambda chain, kv: chain.when(label == kv[0], kv[1][i]), DIMENSIONS.items(), F).otherwise(DIMENSIONS["neutral"][i])
    s = F.coalesce(numbers.clamp(stress / 10, 0.0, 1.0), F.lit(0.0)) if stress is not None else F.lit(0.0)
    valence, arousal, control = pick(0) - s * 0.18, pick(1) + s * 0.14, pick(2) - s * 0.16
    if visual is not None:
        arousal = F.when(visual.isNotNull() & (label != "neutral"), arousal * 0.8 + numbers.clamp(visual, 0.0, 1.0) * 0.2).otherwise(arousal)
    level = lambda x: F.when(x >= 0.67, "high").when(x >= 0.34, "medium").otherwise("low")
    sign = lambda x: F.when(x >= 0.25, "positive").when(x <= -0.25, "negative").otherwise("neutral")
    two = lambda x, low: F.round(numbers.clamp(x, low, 1.0), 2)
    made = {"valence": (two(valence, -1.0), sign), "arousal": (two(arousal, 0.0), level), "control": (two(control, 0.0), level), "intensity": (two(intensity, 0.0), level)}
    return F.struct(*(F.struct(v.alias("score"), f(v).alias("label")).alias(n) for n, (v, f) in made.items()))


def emotion(c: Column, lexicon: Mapping[str, Sequence[str]], distress: Sequence[str] = (), lonely: Sequence[str] = (), stress: Column | None = None, face: Column | None = None, face_confidence: Column | None = None, **how) -> Column:
    """struct(label, secondary, intensity, dimensions, risk_relevant).

    The label with most terms; lonely terms overrule it, distress terms overrule
    all; without any term the face's emotion counts.
    """
    found = [F.struct(F.size(F.filter(_terms(v), lambda t: F.contains(text.text_or_empty(c), t))).alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("label")) for i, (k, v) in enumerate(lexicon.items())]
    ranked = F.sort_array(F.filter(F.array(*found), lambda x: x["n"] > 0), asc=False)
    top = F.get(ranked, F.lit(0))
    deep = F.size(unnegated_terms(c, distress, reach=12, before=(), **how)) if distress else F.lit(0)
    alone = text.contains_any(c, lonely)
    plain = F.coalesce(top["label"], F.lower(face) if face is not None else F.lit(None), F.lit("neutral"))
    label = F.when(deep > 0, "sadness").when(alone, "loneliness").otherwise(plain)
    tied = (F.size(ranked) >= 2) & (F.get(ranked, F.lit(1))["n"] == top["n"])
    others = F.transform(F.when(tied, F.filter(F.slice(ranked, 1, 3), lambda x: x["label"] != top["label"])).otherwise(F.slice(ranked, 2, 2)), lambda x: x["label"])
    others = F.when(alone & (plain != "loneliness"), F.slice(F.concat(F.array(plain), F.filter(others, lambda x: x != "loneliness")), 1, 2)).otherwise(others)
    others = F.when(deep > 0, F.array(F.lit("anxiety"), F.lit("stress"))).otherwise(others)
    own = F.coalesce(F.get(F.transform(F.filter(ranked, lambda x: x["label"] == label), lambda x: x["n"]), F.lit(0)), F.lit(0))
    base = F.when(deep > 0, 0.9 + F.least(deep, F.lit(2)) * 0.02).when((own == 0) & (label == "neutral"), 0.35).otherwise(0.58 + F.least(own, F.lit(3)) * 0.08)
    if stress is not None:
        base = base + F.coalesce(numbers.clamp(stress, 0, 10) * 0.02, F.lit(0.0))
    intensity = F.round(F.least(base, F.lit(0.95)), 2)
    return F.struct(label.alias("label"), others.alias("secondary"), intensity.alias("intensity"), emotion_dimensions(label, intensity, stress, face_confidence).alias("dimensions"), (deep > 0).alias("risk_relevant"))


def visual_emotion(cues: Column, candidates: Column, faces: Mapping[str, str], lexicon: Mapping[str, Sequence[str]]) -> Column:
    """struct(label, confidence, source): the surest known face (0.82 at most), else the cues' label (0.62), else null."""
    table = F.create_map(*(x for k, v in faces.items() for x in (F.lit(k), F.lit(v))))
    known = F.filter(F.transform(candidates, lambda x: F.struct(F.least(x["confidence"].cast("double"), F.lit(0.82)).alias("confidence"), table[F.lower(x["label"])].alias("label"))), lambda x: x["label"].isNotNull() & (x["confidence"] > 0))
    best = F.array_max(known)
    cue = best_label(F.array_join(cues, "；"), lexicon, "")
    return F.when(F.size(known) > 0, F.struct(best["label"].alias("label"), best["confidence"].alias("confidence"), F.lit("vision_model").alias("source"))).when(
        cue["label"] != "", F.struct(cue["label"].alias("label"), F.lit(0.62).alias("confidence"), F.lit("visual_cue_rules").alias("source"))
    )


def first_cause(c: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """struct(category, specific, evidence_terms): the first cause with a term; ``other`` for any other text, ``unknown`` for none."""
    hits = F.filter(F.array(*(F.struct(F.lit(k).alias("category"), text.matching_terms(c, list(v)).alias("terms")) for k, v in lexicon.items())), lambda x: F.size(x["terms"]) > 0)
    top = F.get(hits, F.lit(0))
    body = text.text_or_empty(c)
    at = F.call_function("instr", F.lower(body), F.lower(F.get(top["terms"], F.lit(0))))
    start = F.greatest(F.lit(1), at - 28)
    near = text.strip(F.substring(body, start, at - start + F.length(F.get(top["terms"], F.lit(0))) + 48))
    none = F.array().cast("array<string>")
    return (
        F.when(top.isNotNull(), F.struct(top["category"].alias("category"), near.alias("specific"), F.slice(top["terms"], 1, 5).alias("evidence_terms")))
        .when(~text.is_blank(c), F.struct(F.lit("other").alias("category"), F.substring(text.strip(body), 1, 90).alias("specific"), none.alias("evidence_terms")))
        .otherwise(F.struct(F.lit("unknown").alias("category"), F.lit("").alias("specific"), none.alias("evidence_terms")))
    )


# Groups of causes and emotions that the decisions name.
STUDY = ("thesis", "research", "exam", "academic", "employment")
PEOPLE = ("loneliness", "interpersonal", "roommate", "romantic_relationship", "family")
NEGATIVE = ("anxiety", "sadness", "anger", "fatigue", "loneliness", "stress", "fear", "shame", "guilt")
READY = ("goal_setting", "intervention", "follow_up")


def needs(c: Column, primary: Column, intensity: Column, cause: Column, risk: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """What a person needs, five at most, the surest first."""
    when = lambda cond, *names: F.when(cond, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    parts = [
        when(risk.isin("medium", "high"), "safety"), when(primary.isin(*NEGATIVE) | (intensity >= 0.55), "emotional_validation", "being_heard"),
        text.matching_labels(c, rules), when(cause.isin(*STUDY), "clarity", "sense_of_control"), when(cause.isin(*PEOPLE), "social_connection"),
        when(cause == "sleep", "rest"), when(cause == "self_evaluation", "self_compassion"),
    ]
    all_ = F.array_distinct(F.concat(*parts))
    return F.when(F.size(all_) == 0, F.array(F.lit("unknown"))).otherwise(F.slice(all_, 1, 5))


def state_confidence(c: Column, primary: Column, intensity: Column, cause: Column, need: Column, risk: Column) -> Column:
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    value = (
        F.lit(0.34) + add(F.length(text.strip(c)) >= 8, 0.12) + add(~primary.isin("neutral", "unknown"), 0.18) + add(intensity >= 0.65, 0.08)
        + F.when(~cause.isin("unknown", "other"), 0.18).when(cause == "other", 0.05).otherwise(0.0) + add(need != F.array(F.lit("unknown")), 0.08) + add(risk.isin("medium", "high"), 0.08)
    )
    return F.round(numbers.clamp(value, 0.22, 0.92), 2)


def stage(c: Column, cause: Column, need: Column, confidence: Column, follow_up: Sequence[str] = (), greeting: Sequence[str] = (), least: float = 0.5) -> Column:
    return (
        F.when(text.contains_any(c, follow_up), "follow_up").when(text.contains_any(c, greeting) & (F.length(text.strip(c)) <= 12), "relationship_building")
        .when(confidence < least, "exploration").when(F.arrays_overlap(need, _terms(("problem_solving", "information"))), "intervention")
        .when(cause == "unknown", "cause_exploration").when(cause == "other", "exploration").when(F.array_contains(need, "clarity"), "goal_setting").otherwise("emotion_clarification")
    )


def plan(risk: Column, primary: Column, cause: Column, stage_: Column, need: Column, confidence: Column, least: float = 0.5) -> Column:
    """struct(primary_strategy, secondary_strategy, should_give_advice, should_ask_question, should_use_rag, reason, confidence): the first rule that fits."""
    has = lambda *n: F.arrays_overlap(need, _terms(n))
    ready = stage_.isin(*READY)

    def out(first: str | Column, second: Sequence[str], advice: bool | Column, ask: bool, rag: bool | Column, reason: str, sure: float | Column | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        sure = F.when(lit(advice), 0.86).otherwise(0.78) if sure is None else F.lit(sure)
        return F.struct(
            lit(first).alias("primary_strategy"), _terms(second).alias("secondary_strategy"), lit(advice).alias("should_give_advice"), F.lit(ask).alias("should_ask_question"),
            lit(rag).alias("should_use_rag"), F.lit(reason).alias("reason"), sure.alias("confidence"),
        )

    talk = has("problem_solving") | ready
    return (
        F.when(risk == "high", out("referral", ("supportive_presence",), False, False, False, "high_risk_crisis_flow", 0.95))
        .when(risk == "medium", out("grounding", ("emotional_validation", "clarification", "supportive_presence"), False, True, False, "medium_risk_support_with_monitoring", 0.82))
        .when(confidence < least, out("clarification", ("reflection", "emotional_validation", "open_question"), False, True, False, "low_psychological_state_confidence", 0.72))
        .when((cause == "sleep") | has("rest"), out(F.when(has("information"), "information").otherwise("problem_solving"), ("emotional_validation", "grounding"), True, True, True, "sleep_or_rest_need"))
        .when(cause.isin(*STUDY), out("problem_solving", ("emotional_validation", "clarification"), True, True, True, "academic_or_career_cause"))
        .when(cause.isin(*PEOPLE), out("emotional_validation", ("open_question", "problem_solving"), talk, True, talk, "relationship_or_connection_cause"))
        .when((cause == "self_evaluation") | has("self_compassion", "encouragement"), out("self_compassion", ("cognitive_reappraisal", "affirmation"), True, True, True, "self_evaluation_or_self_compassion_need"))
        .when(primary.isin("sadness", "fatigue", "loneliness") & ready, out("behavioral_activation", ("emotional_validation", "self_compassion"), True, True, True, "low_mood_activation"))
        .when(has("information"), out("information", ("emotional_validation",), True, True, True, "needs_information"))
        .when(has("problem_solving"), out("problem_solving", ("emotional_validation", "clarification"), True, True, True, "needs_problem_solving"))
        .otherwise(out("emotional_validation", ("reflection",), False, True, False, "supportive_default"))
    )


def route(message: Column, risk: Column, use_rag: Column, confidence: Column, cause: Column, primary: Column, strategy: Column, need: Column, conditions: Mapping[str, Sequence[str]], cause_topics: Mapping[str, Sequence[str]], cause_collections: Mapping[str, Sequence[str]], strategy_terms: Mapping[str, Sequence[str]], diagnostic: Sequence[str] = (), least: float = 0.5) -> Column:
    """struct(should_retrieve, collections, topics, use_mode, query, top_k, reason, fallback)."""
    table = lambda m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), _terms(v)))) if m else F.create_map().cast("map<string,array<string>>")
    none = F.array().cast("array<string>")
    found = text.matching_labels(message, conditions)
    found = F.when((F.size(found) > 0) & text.contains_any(message, diagnostic), F.concat(found, F.array(F.lit("professional_help")))).otherwise(found)
    of = lambda m, key: F.coalesce(table(m)[key], none)
    topics = text.distinct_ignoring_case(F.concat(of(cause_topics, cause), need, of(strategy_terms, strategy)))
    collections = F.coalesce(table(cause_collections)[cause], _terms(("interventions", "professional_knowledge")))

    def out(go: bool, colls: Column, tops: Column, mode: str, query: Column, reason: str | Column, fallback: str) -> Column:
        return F.struct(F.lit(go).alias("should_retrieve"), colls.alias("collections"), tops.alias("topics"), F.lit(mode).alias("use_mode"), query.alias("query"), F.lit(3 if go else 0).alias("top_k"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(fallback).alias("fallback"))

    skip = lambda reason, fallback: out(False, none, none, "", message, reason, fallback)
    asked = F.concat_ws(" ", message, F.concat(F.lit("cause:"), cause), F.concat(F.lit("emotion:"), primary), F.concat(F.lit("strategy:"), strategy), F.array_join(topics, " "))
    return (
        F.when(risk == "high", skip("high_risk_skip_ordinary_rag", "safety_agent_crisis_referral")).when(risk == "medium", skip("medium_risk_confirm_safety_before_rag", "support_with_monitoring"))
        .when(~use_rag, skip("strategy_plan_does_not_need_knowledge", "supportive_reply_without_sources")).when(confidence < least, skip("psychological_state_low_confidence", "clarification_before_retrieval"))
        .when(F.size(found) > 0, out(True, F.array(F.lit("professional_knowledge")), found, "psychoeducation_only", F.concat_ws(" ", message, F.lit("psychoeducation professional help"), F.array_join(found, " ")), "condition_psychoeducation", "psychoeducation_with_professional_assessment_boundary"))
        .otherwise(out(True, collections, topics, "", asked, "strategy_plan_requires_knowledge", "no_source_general_support"))
    )


def reviewed_reply(reply: Column, risk_level: Column, unsafe: str, crisis_template: str, safe_template: str) -> Column:
    """The reply, or a template where risk is high or the reply breaks a boundary."""
    return F.when(risk_level == "high", F.lit(crisis_template)).when(text.text_or_empty(reply).rlike(unsafe), F.lit(safe_template)).otherwise(reply)


def source_quality(authority: Column, evidence_: Column, relevance: Column, legal: Column, freshness: Column, distinctness: Column) -> Column:
    """struct(score, decision) of a candidate source's six parts."""
    score = authority + evidence_ + relevance + legal + freshness + distinctness
    return F.struct(score.alias("score"), F.when(score >= 80, "accept").when(score >= 65, "review").when(score >= 50, "hold").otherwise("reject").alias("decision"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float | None, price_out: float | None) -> Column:
    """The price of a call in thousands of tokens; null without prices."""
    if price_in is None or price_out is None:
        return F.lit(None).cast("double")
    return F.round(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, 6)


def use_mode(collection: Column, clinical: Column, kind: Column, given: Column | None = None) -> Column:
    """How texts of a source may be used: what is given, else the first rule that fits."""
    rule = (
        F.when(collection == "safety", "safety_only").when(F.coalesce(clinical, F.lit(False)), "clinical_reference_only").when(collection == "evidence", "evidence_only")
        .when(collection == "helping_skills", "helping_skills_only").when(collection == "governance", "agent_policy_only").when(F.lower(kind).contains("guideline"), "psychoeducation_only").otherwise("direct_user_support")
    )
    return rule if given is None else F.when(text.is_blank(given), rule).otherwise(given)
