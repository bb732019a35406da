"""Curating dialogues for supervised tuning: records, metrics, reject rules, duplicates, scores, balanced selection.

The input is the long form of dialogues, one row per turn: (conv_id, turn, role,
text). ``records`` brings the turns of a dialogue together in one shuffle by
conv_id; all that follows works within a record, or on keys of records.

Defined cases: null texts and roles count as empty; a dialogue without usable
turns stays as a record with no messages, which the rules reject; turns of one
number are ordered by role and text; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.functions import numbers, text
from tarnweave.operators import selection
from tarnweave.session import broadcast_if_small, drop_settled, settle

# Role names in use, and the patterns of the reject rules. All can be replaced through ``Rules``.
ROLES = {
    "user": ("user", "human", "client", "patient", "seeker", "用户", "求助者", "来访者", "学生"),
    "assistant": ("assistant", "bot", "gpt", "chatgpt", "counselor", "therapist", "psychologist", "咨询师", "治疗师", "助手", "老师", "小天"),
    "source_system": ("system", "prompt", "规则", "设定"),
}
GENERIC = r"^(好的|嗯+|呃+|啊+|是的|可以|没事|没关系|加油|我理解|理解你|不客气|谢谢|明白|继续说|请继续)[。！!,.，\s]*$"
HIGH_RISK = r"(自杀|轻生|想死|不想活|结束生命|伤害自己|自残|割腕|跳楼|吞药|寻死|活不下去|杀了自己|伤害他人|杀人)"
SAFETY_REPLY = (
    r"(紧急|立即|马上|急救|120|110|报警|危机|热线|安全计划|不要独自|陪在你身边|联系.{0,8}(家人|朋友|老师|辅导员|医生|心理中心|可信任的人)|"
    r"专业帮助|现实中的帮助|远离.{0,8}(刀|药|窗|危险))"
)
MEDICATION = (
    r"((建议|应该|可以|需要|必须).{0,10}(服用|吃|使用|加用).{0,18}(药|抗抑郁|安眠|镇静|抗焦虑|处方))|"
    r"((增加|减少|调整|停止|停用|停药|换药|加大|减小).{0,8}(剂量|药量|用药|药))"
)
MEDICATION_SAFE = r"(不要自行|不能自行|请咨询|咨询医生|遵医嘱|由医生|专业医生|精神科医生)"
DIAGNOSIS = (
    r"(你(已经)?(患有|得了|就是|属于).{0,12}(抑郁症|焦虑症|强迫症|双相|精神分裂|创伤后应激|PTSD|进食障碍|人格障碍))|(这说明你有.{0,12}(疾病|障碍|症))"
)
GUARANTEE = r"(一定会(好|康复|恢复)|肯定能(治好|恢复|康复)|保证.{0,8}(治好|恢复|康复)|必然.{0,8}(康复|好起来))"
PROCEDURE = r"((我来|现在|马上).{0,12}(催眠|暴露治疗|系统脱敏|EMDR|眼动脱敏|创伤治疗))"
DISTRESS = r"(绝望|崩溃|活不下去|严重|每天|长期|无法|失控|痛苦|抑郁|焦虑|恐惧|惊恐)"
MARKUP = r"(###|<\|end|用户：|助手：|Assistant:|Human:)"
# Labels by pattern, the first that matches counts for problems.
PROBLEMS = {
    "学习与论文压力": r"(学习|作业|考试|论文|绩点|挂科|课堂|导师|科研|考研|复习)",
    "就业与未来焦虑": r"(就业|工作|实习|面试|简历|职业|毕业|未来|offer|招聘)",
    "人际关系": r"(朋友|同学|室友|关系|社交|孤立|吵架|矛盾|人际|相处)",
    "亲密关系": r"(恋爱|分手|对象|男友|女友|喜欢的人|暧昧|伴侣|感情)",
    "家庭压力": r"(父母|家庭|妈妈|爸爸|家里|亲人|原生家庭|家长)",
    "睡眠困扰": r"(睡不着|失眠|熬夜|早醒|睡眠|做梦|入睡)",
    "孤独与低落": r"(孤独|寂寞|空虚|低落|难过|痛苦|崩溃|无助|绝望)",
    "自我与控制感": r"(自卑|自责|内耗|迷茫|意义|价值|控制|失控|拖延)",
    "情绪调节": r"(焦虑|紧张|压力|生气|愤怒|烦躁|恐惧|害怕|抑郁)",
}
FOCUSES = {
    "安全支持": r"(自杀|轻生|自残|伤害|不想活|想死|危机)",
    "认知重评": r"(想法|认知|看法|评价|灾难化|应该|必须|自责|否定)",
    "情绪命名": r"(情绪|感受|难过|焦虑|愤怒|害怕|低落|委屈)",
    "行动计划": r"(计划|步骤|尝试|安排|行动|目标|任务|练习)",
    "社会支持": r"(朋友|家人|老师|辅导员|同学|心理中心|倾诉|求助)",
    "自我接纳": r"(接纳|允许|善待|价值|自我|自卑|自信|内疚)",
}
STRATEGIES = {
    "safety_planning": r"(安全|紧急|热线|120|110|报警|危机|不要独自|远离危险)",
    "empathy_validation": r"(能理解|听起来|这很不容易|辛苦|委屈|难受|我在|被看见)",
    "open_question": r"(愿意说说|可以讲讲|发生了什么|你觉得|是什么让|能不能告诉我|想先谈)",
    "emotion_labeling": r"(你可能感到|这像是|情绪|感受|焦虑|低落|愤怒|害怕)",
    "cognitive_reframe": r"(换个角度|想法|证据|是否一定|也许|重新看待|认知)",
    "problem_solving": r"(第一步|可以先|计划|列出来|拆分|安排|具体做法|下一步)",
    "grounding_relaxation": r"(呼吸|放松|正念|落地|身体扫描|渐进式|五感)",
    "psychoeducation": r"(心理学|常见反应|压力反应|情绪调节|机制|研究|说明)",
    "resource_referral": r"(辅导员|心理中心|咨询师|医生|专业帮助|学校资源|可信任的人)",
}


@dataclass(frozen=True)
class Rules:
    """What the curation of one corpus goes by; patterns are Java's."""

    roles: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: ROLES)
    generic: str = GENERIC
    high_risk: str = HIGH_RISK
    safety_reply: str = SAFETY_REPLY
    medication: str = MEDICATION
    medication_safe: str = MEDICATION_SAFE
    flags: Mapping[str, str] = field(default_factory=lambda: {"direct_diagnosis": DIAGNOSIS, "recovery_guarantee": GUARANTEE, "professional_only_procedure": PROCEDURE})
    distress: str = DISTRESS
    markup: str = MARKUP
    problems: Mapping[str, str] = field(default_factory=lambda: PROBLEMS)
    focuses: Mapping[str, str] = field(default_factory=lambda: FOCUSES)
    strategies: Mapping[str, str] = field(default_factory=lambda: STRATEGIES)
    problem_default: str = "通用心理支持"
    focus_default: str = "情绪支持"
    group_default: str = "通用人群"

    def with_(self, **changes) -> Rules:
        return replace(self, **changes)


def map_role(role: Column, rules: Rules = Rules()) -> Column:
    """``user``, ``assistant``, ``source_system`` or null."""
    low = F.lower(text.strip(role))
    order = ("source_system", "user", "assistant")
    return reduce(lambda chain, kind: chain.when(low.isin(*rules.roles[kind]), kind), order, F).otherwise(None)


def records(turns: DataFrame, rules: Rules = Rules(), conv: str = "conv_id", turn: str = "turn", role: str = "role", body: str = "text") -> DataFrame:
    """(conv_id, messages, empty_raw_messages, unknown_role_messages, source_system_messages).

    Turns of one role in a row become one message; messages before the first
    of a user and after the last of an assistant go. One shuffle by dialogue.
    """
    kind, content = map_role(F.col(role), rules), text.clean(F.col(body))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), kind.alias("kind"), content.alias("content"), F.col(role).alias("role"))
    usable = (F.col("content") != "") & F.coalesce(F.col("kind").isin("user", "assistant"), F.lit(False))
    rows = rows.withColumn("usable", usable)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.last(F.when(F.col("usable"), F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("usable") & ~before.eqNullSafe(F.col("kind"))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("turn", "role", "content")
    runs = rows.groupBy("conv_id", "run").agg(
        F.max(F.when(F.col("usable"), F.col("kind"))).alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("usable"), piece))), lambda p: p["content"]), "\n").alias("content"),
        F.count_if(F.col("content") == "").alias("empty"),
        F.count_if((F.col("content") != "") & F.col("kind").isNull()).alias("unknown"),
        F.count_if((F.col("content") != "") & (F.col("kind") == "source_system")).alias("system"),
    )
    message = F.when(F.col("kind").isNotNull() & (F.col("kind") != "source_system"), F.struct("run", F.col("kind").alias("role"), "content"))
    whole = runs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(message)).alias("runs"), F.sum("empty").alias("empty_raw_messages"), F.sum("unknown").alias("unknown_role_messages"), F.sum("system").alias("source_system_messages"),
    )
    names = F.transform("runs", lambda m: m["role"])
    first = F.array_position(names, F.lit("user"))
    last = F.size(names) + 1 - F.array_position(F.reverse(names), F.lit("assistant"))
    some = (first > 0) & F.array_contains(names, "assistant") & (last >= first)
    trimmed = F.when(some, F.slice("runs", first.cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int"))).otherwise(F.slice("runs", 1, 0))
    bare = F.transform(trimmed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return whole.select("conv_id", bare.alias("messages"), "empty_raw_messages", "unknown_role_messages", "source_system_messages")


def said_by(messages: Column, role: str | None = None) -> Column:
    """The contents of the messages, or of one role's."""
    return F.transform(messages if role is None else F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def all_text(messages: Column, role: str | None = None) -> Column:
    return F.array_join(said_by(messages, role), "\n")


def with_labels(recs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``recs`` with problem, support_focus, strategy_path and severity, as far as they aren't there; group and cause default."""
    user, assistant, everyone = (all_text(F.col("messages"), r) for r in ("user", "assistant", None))
    focus = F.array_join(F.slice(text.matching_patterns(everyone, rules.focuses), 1, 3), "、")
    strategies = text.matching_patterns(assistant, rules.strategies)
    derived = {
        "problem": text.first_pattern(user, rules.problems, rules.problem_default),
        "support_focus": F.when(focus == "", rules.focus_default).otherwise(focus),
        "strategy_path": F.when(F.size(strategies) == 0, F.array(F.lit("supportive_dialogue"))).otherwise(strategies),
        "severity": F.when(text.matches(user, rules.high_risk), "high").when(text.matches(user, rules.distress), "medium").otherwise("low"),
        "group": F.lit(rules.group_default),
        "cause": F.lit("unknown_cause"),
    }
    for name, value in derived.items():
        if name not in recs.columns:
            recs = recs.withColumn(name, value)
        elif name == "strategy_path":
            recs = recs.withColumn(name, F.array_distinct(F.concat(F.coalesce(name, F.array().cast("array<string>")), derived[name])))
        else:
            recs = recs.withColumn(name, F.when(text.is_blank(F.col(name)), value).otherwise(text.strip(F.col(name))))
    return recs


def immediate_safety(messages: Column, rules: Rules = Rules()) -> Column:
    """Whether there is a high-risk user message, and an assistant answers each within two messages, its first answer being a safe one."""
    risky = lambda m: (m["role"] == "user") & text.matches(m["content"], rules.high_risk)

    def answered(m: Column, i: Column) -> Column:
        one, two = F.get(messages, i + 1), F.get(messages, i + 2)
        safe = lambda x: F.coalesce(text.matches(x["content"], rules.safety_reply), F.lit(False))
        return F.when(~risky(m), True).when(one["role"] == "assistant", safe(one)).when(two["role"] == "assistant", safe(two)).otherwise(False)

    return F.exists(messages, risky) & F.forall(F.transform(messages, answered), lambda x: x)


def with_metrics(recs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``recs`` with turn counts, lengths, an estimate of tokens, ratios and flags."""
    messages = F.col("messages")
    recs = recs.withColumn("_a", said_by(messages, "assistant"))
    replies = F.col("_a")
    turns = F.greatest(F.lit(1), F.size(replies))
    summed = lambda arr, f: F.aggregate(arr, F.lit(0), lambda t, x: t + f(x).cast("int"))
    low = F.size(F.filter(replies, lambda x: (F.length(text.strip(x)) < 12) | text.matches(text.strip(x), rules.generic)))
    distinct = F.size(F.array_distinct(F.transform(F.filter(replies, lambda x: ~text.is_blank(x)), text.dense_key)))
    every = said_by(messages)
    characters = summed(every, F.length) + F.greatest(F.lit(0), F.size(messages) - 1)
    counted = lambda pattern: summed(every, lambda x: text.count_of(x, pattern))
    tokens = text.tokens_from_counts(counted(text.CJK), counted(text.LATIN_WORD), characters)
    some = lambda pattern, role: F.exists(said_by(messages, role), lambda x: text.matches(x, pattern))
    directive = some(rules.medication, "assistant") & ~some(rules.medication_safe, "assistant")
    flags = [F.when(directive, "medication_directive"), *(F.when(some(p, "assistant"), name) for name, p in rules.flags.items())]
    return recs.withColumns({
        "turn_count": F.size(messages), "assistant_turns": F.size(replies), "user_turns": F.size(said_by(messages, "user")),
        "characters": characters, "estimated_tokens": tokens,
        "assistant_mean_chars": F.round(summed(replies, F.length) / turns, 2),
        "low_information_ratio": F.round(low / turns, 4),
        "repeated_assistant_ratio": F.round(F.greatest(F.lit(0), turns - distinct) / turns, 4),
        "high_risk_user": some(rules.high_risk, "user"), "safety_adequate": some(rules.safety_reply, "assistant"),
        "high_risk_immediate_safety": immediate_safety(messages, rules), "boundary_flags": F.array_compact(F.array(*flags)),
    }).drop("_a")


def reject_reason() -> Column:
    """The first rule that a record with metrics breaks, or null."""
    m, c = F.col("messages"), F.col
    has = lambda role: F.exists(m, lambda x: x["role"] == role)
    return (
        F.when(F.size(m) < 2, "broken_conversation")
        .when(~has("user"), "no_user_message")
        .when(~has("assistant"), "no_assistant_message")
        .when(c("unknown_role_messages") > F.greatest(F.lit(2.0), F.size(m) * 0.3), "role_mapping_failed")
        .when(c("assistant_turns") == 0, "assistant_empty")
        .when(c("low_information_ratio") >= 0.7, "low_information")
        .when((c("assistant_mean_chars") < 16) & (c("turn_count") < 8), "assistant_too_short")
        .when(c("estimated_tokens") < 80, "too_short_for_sft")
        .when(c("estimated_tokens") > 5200, "too_long_for_single_sft_sample")
        .when(F.size("boundary_flags") > 0, F.concat(F.lit("unsafe_boundary_"), F.array_join("boundary_flags", "|")))
        .when(c("high_risk_user") & ~c("high_risk_immediate_safety"), "high_risk_without_safety_response")
    )


def with_hashes(recs: DataFrame) -> DataFrame:
    """``recs`` with exact_hash (of the messages as compact JSON), normalized_hash and a 32-bit fingerprint of the whole text."""
    key = text.dense_key(all_text(F.col("messages")))
    return recs.withColumns({"exact_hash": F.sha2(F.to_json("messages"), 256), "_key": key}).withColumns({"normalized_hash": F.sha2("_key", 256), "simhash": numbers.whole_fingerprint32(F.col("_key"))}).drop("_key")


# --- duplicates -------------------------------------------------------------


def close_fingerprints(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct 32-bit fingerprints that differ in one or two bits.

    Two such fingerprints have a third within one bit of both, so each emits
    itself and its 32 neighbours, and those of one value meet. A group has at
    most 33 members, whatever the data: no bucket can grow hot. As a member is the value
    but for one bit or none, a group is a mask of 33 bits, and its aggregate a plain number.
    A pair meets at two values; that counts where the smaller one has the smaller bit.
    """
    flipped = lambda c, b: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b).bitwiseAND(F.lit((1 << 32) - 1)))
    bits = F.sequence(F.lit(0), F.lit(32))  # 32: the fingerprint itself
    keyed = fps.select("fp", F.explode(bits).alias("bit")).select(flipped(F.col("fp"), F.col("bit")).alias("key"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")).alias("mask"))
    # nearly all values have one member, so that aggregates ahead of the shuffle would only cost
    near = keyed.repartition("key").groupBy("key").agg(F.bit_or("mask").alias("mask")).where(F.bit_count("mask") > 1)
    ball = F.transform(F.filter(bits, lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1), lambda b: F.struct(b.alias("bit"), flipped(F.col("key"), b).alias("fp")))
    later = lambda x: F.filter("ball", lambda y: (y["bit"] > x["bit"]) & (y["fp"] > x["fp"]))
    pair = F.explode(F.flatten(F.transform("ball", lambda x: F.transform(later(x), lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b"))))))
    return near.select(ball.alias("ball")).select(pair.alias("p")).select("p.a", "p.b")


def first_kept(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): those that stay if each, in the order ``at``, goes when an earlier one that stays is linked to it.

    Rounds of joins: a node without an open earlier link stays, and what is
    linked to it and comes later goes. The rounds are as many as the longest chain
    of such decisions, each is settled, and only a count comes to the driver.
    """
    ranked = edges.join(nodes.select(F.col("node").alias("a"), F.col("at").alias("at_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("at").alias("at_b")), "b")
    earlier = F.when(F.col("at_a") < F.col("at_b"), F.col("a")).otherwise(F.col("b"))
    later = F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a"))
    waiting = settle(ranked.select(later.alias("node"), earlier.alias("by")), "open-links")
    gone = None
    while waiting.limit(1).count():
        free = waiting.select(F.col("by").alias("node")).distinct().join(waiting.select("node").distinct(), "node", "left_anti")
        dropped = settle(waiting.join(free.select(F.col("node").alias("by")), "by", "left_semi").select("node").distinct(), "dropped")
        gone = dropped if gone is None else settle(gone.union(dropped), "gone")
        rest = waiting.join(dropped, "node", "left_anti").join(dropped.select(F.col("node").alias("by")), "by", "left_anti")
        rest = settle(rest.select("node", "by"), "open-links")
        drop_settled(waiting)
        waiting = rest
    return nodes.select("node") if gone is None else nodes.select("node").join(gone, "node", "left_anti")


def duplicates(recs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, duplicate_of, method): records that repeat an earlier kept one (by id): same messages, same text but for
    case and punctuation, or a fingerprint at most two bits away. No limit on candidates is needed."""
    rows = settle(recs.select(F.col(id_col).alias("id"), "exact_hash", "normalized_hash", F.col("simhash").alias("fp")), "hashed-records")
    nodes = settle(rows.groupBy("fp").agg(F.min("id").alias("at")).withColumnRenamed("fp", "node"), "fingerprint-nodes")
    edges = settle(close_fingerprints(nodes.select(F.col("node").alias("fp"))), "close-fingerprints")
    kept = settle(first_kept(nodes, edges).join(nodes, "node"), "kept-fingerprints")
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    near = both.join(kept.select(F.col("node").alias("b"), F.col("at").alias("other")), "b").join(nodes.select(F.col("node").alias("a"), "at"), "a").where("other < at")
    band = F.least(*(F.when(F.shiftright(F.col("a").bitwiseXOR(F.col("b")), 8 * i).bitwiseAND(F.lit(255)) == 0, i).otherwise(9) for i in range(4)))
    close = near.groupBy(F.col("a").alias("fp")).agg(F.min(F.struct(band.alias("band"), "other")).alias("m")).select("fp", F.col("m.other").alias("close_to"))
    # of a fingerprint without a kept neighbour the first record is kept, and it alone: the others repeat it in one way or another
    first = rows.groupBy("fp").agg(F.min_by(F.struct("id", "exact_hash", "normalized_hash"), "id").alias("first"))
    found = rows.join(settle(first, "first-records"), "fp").join(broadcast_if_small(settle(close, "close-records"), 32), "fp", "left")
    how = F.when(F.col("first.exact_hash") == F.col("exact_hash"), "exact_hash").when(F.col("first.normalized_hash") == F.col("normalized_hash"), "normalized_hash").otherwise("fingerprint")
    target = F.when(F.col("close_to").isNotNull(), F.struct(F.col("close_to").alias("of"), F.lit("fingerprint").alias("method")))
    target = target.when(F.col("first.id") < F.col("id"), F.struct(F.col("first.id").alias("of"), how.alias("method")))
    return found.select("id", target.alias("t")).where(F.col("t").isNotNull()).select(F.col("id").alias(id_col), F.col("t.of").alias("duplicate_of"), F.col("t.method").alias("method"))


# --- scores -----------------------------------------------------------------

LABELS = ("group", "problem", "cause", "support_focus", "severity")


def label_pairs(id_col: str = "conv_id") -> Column:
    """All (field, value) labels of a record but the unknown ones."""
    single = F.array(*(F.struct(F.lit(name).alias("field"), text.label_or(F.col(name)).alias("value")) for name in LABELS))
    path = F.transform("strategy_path", lambda s: F.struct(F.lit("strategy").alias("field"), text.label_or(s).alias("value")))
    return F.filter(F.concat(single, path), lambda p: p["value"] != "unknown")


def label_counts(recs: DataFrame) -> DataFrame:
    """(field, value, n, total): how many records have a label, and how many labels the field has given."""
    counts = recs.select(F.explode(label_pairs()).alias("p")).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("field")))


def with_scores(recs: DataFrame, counts: DataFrame, id_col: str = "conv_id", p5: float = 80, p50: float = 600, p95: float = 2500) -> DataFrame:
    """``recs`` with quality_score, coverage_score and final_score (0 to 100)."""
    rare = F.log((F.col("total") + 1) / (F.col("n") + 1) + 1) / F.log(F.col("total") + 1)
    pairs = recs.select(F.col(id_col).alias("_id"), F.explode(label_pairs()).alias("p")).select("_id", "p.field", "p.value")
    rarity = pairs.join(broadcast_if_small(settle(counts, "label-counts"), 128), ["field", "value"]).groupBy("_id").agg(F.avg(rare).alias("_rarity"))
    recs = recs.join(rarity, recs[id_col] == rarity["_id"], "left").drop("_id")
    c = F.col
    quality = F.lit(30.0) - c("low_information_ratio") * 12 - c("repeated_assistant_ratio") * 8
    quality = quality - F.when(c("assistant_mean_chars") < 30, 4).otherwise(0) - F.least(F.lit(5), c("unknown_role_messages"))
    quality = numbers.clamp(quality + F.when(c("high_risk_user") & c("safety_adequate"), 1.5).otherwise(0.0), 0.0, 30.0)
    n = F.size(F.array_distinct("strategy_path"))
    strategy = F.when(n == 0, 6.0).when(n == 1, 12.0).when(n <= 4, 17.0 + n * 0.5).otherwise(20.0)
    coverage = numbers.clamp(8.0 + 12.0 * F.coalesce("_rarity", F.lit(0.25)), 0.0, 20.0)
    turns, tokens = c("turn_count"), c("estimated_tokens")
    depth = F.when(turns.between(6, 24), 15.0).when(turns.between(4, 5) | turns.between(25, 36), 12.0).when(turns > 36, 8.0).otherwise(7.0)
    everything = all_text(c("messages"))
    natural = 10.0 - F.when(everything.rlike(MARKUP), 2.0).otherwise(0.0) - F.when(F.regexp_count(everything, F.lit("[A-Za-z]{12,}")) > 10, 1.0).otherwise(0.0)
    natural = numbers.clamp(natural - F.least(F.lit(1.0), c("source_system_messages") * 0.2) - c("repeated_assistant_ratio") * 3, 0.0, 10.0)
    usual = tokens.between(p5, p95)
    length = F.when(usual & (F.abs(tokens - p50) <= max(120, p50 * 0.75)), 5.0).when(usual, 4.0).otherwise(2.0)
    final = numbers.clamp(quality + strategy + coverage + depth + natural + length, 0.0, 100.0)
    return recs.withColumns({"quality_score": F.round(quality, 3), "coverage_score": F.round(coverage, 3), "final_score": F.round(final, 3)}).drop("_rarity")


def length_percentiles(recs: DataFrame) -> DataFrame:
    """(name, percentiles): of turn counts, characters and estimated tokens."""
    rows = recs.select(F.explode(F.create_map(*(x for n in ("turn_count", "characters", "estimated_tokens") for x in (F.lit(n), F.col(n))))).alias("name", "v"))
    return rows.groupBy("name").agg(numbers.percentiles(F.col("v")).alias("percentiles"))


def distribution(recs: DataFrame, name: str, top: int = 20) -> DataFrame:
    """(value, n): the most frequent values of a label; an array counts each of its values."""
    value = F.explode(name) if recs.schema[name].dataType.typeName() == "array" else text.label_or(F.col(name))
    return recs.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


# --- selection --------------------------------------------------------------


def top_pool(recs: DataFrame, limit: int, per_label: int = 5, id_col: str = "conv_id") -> DataFrame:
    """The ``limit`` records of highest score and the ``per_label`` best of each label: a pool of bounded size."""
    best = recs.orderBy(F.desc("final_score"), id_col).limit(limit).select(id_col)
    pairs = recs.select(id_col, "final_score", F.explode(F.array_distinct(label_pairs())).alias("p"))
    order = Window.partitionBy("p.field", "p.value").orderBy(F.desc("final_score"), id_col)
    labelled = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).select(id_col)
    return recs.join(best.union(labelled).distinct(), id_col, "left_semi")


def select_balanced(pool: DataFrame, target: int, id_col: str = "conv_id") -> DataFrame:
    """(id): ``target`` records of a pool, balanced over labels as ``selection`` says; texts aren't moved."""
    slim = pool.select(F.col(id_col).alias("id"), "group", "problem", "coverage_score", "final_score")
    labels = pool.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(label_pairs())).alias("p")).select("id", "p.field", "p.value")
    return selection.balanced(slim, labels, target).withColumnRenamed("id", id_col)


def manifest(recs: DataFrame, candidates: DataFrame, selected: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, status, exclude_reason, ...): an audit row per record; selected over candidate over what it was.

    ``recs`` has status and exclude_reason; ``candidates`` and ``selected`` have ids.
    """
    marks = lambda df, name: broadcast_if_small(settle(df.select(id_col).distinct().withColumn(name, F.lit(True)), name), 64)
    rows = recs.join(marks(candidates, "_candidate"), id_col, "left").join(marks(selected, "_selected"), id_col, "left")
    status = F.when(F.col("_selected"), "selected").when(F.col("_candidate") & (F.col("status") == "eligible"), "candidate").otherwise(F.col("status"))
    reason = F.when(F.col("_selected"), "").otherwise(F.coalesce("exclude_reason", F.lit("")))
    return rows.withColumns({"status": status, "exclude_reason": reason, "strategy_path": F.array_join("strategy_path", "|")}).drop("_candidate", "_selected")


def curate(turns: DataFrame, target: int, candidate_target: int, rules: Rules = Rules(), before: DataFrame | None = None) -> DataFrame:
    """The whole chain: one row per dialogue with status, exclude_reason, labels, metrics and scores.

    ``before``: normalized_hash of dialogues selected from earlier corpora, which are duplicates here.
    """
    recs = with_hashes(with_metrics(with_labels(records(turns, rules), rules), rules)).withColumn("reason", reject_reason())
    recs = settle(recs, "curated-records")
    passed = recs.where("reason is null")
    copies = settle(duplicates(passed), "duplicates")
    unique = passed.join(copies.select("conv_id"), "conv_id", "left_anti")
    again = None
    if before is not None:
        again = settle(unique.join(before.select("normalized_hash").distinct(), "normalized_hash", "left_semi").select("conv_id"), "selected-before")
        unique = unique.join(again, "conv_id", "left_anti")
    sizes = {r["name"]: r["percentiles"] for r in length_percentiles(passed).collect()}.get("estimated_tokens", {})
    scored = settle(with_scores(unique, label_counts(passed), p5=sizes.get("p5", 80), p50=sizes.get("p50", 600), p95=sizes.get("p95", 2500)), "scored-records")
    pool = top_pool(scored, max(candidate_target * 6, target * 12, 3000))
    candidates = settle(scored.join(settle(select_balanced(pool, candidate_target), "candidate-ids"), "conv_id", "left_semi"), "candidates")
    selected = settle(select_balanced(candidates, target), "selected-ids")
    why = recs.join(copies, "conv_id", "left")
    status = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("eligible")
    reason = F.coalesce(F.col("reason"), F.concat(F.lit("duplicate_of:"), F.col("duplicate_of").cast("string")))
    if again is not None:
        why = why.join(again.withColumn("_again", F.lit(True)), "conv_id", "left")
        status = F.when(F.col("_again"), "duplicate").otherwise(status)
        reason = F.when(F.col("_again"), "cross_dataset_duplicate_selected_before").otherwise(reason)
    rows = why.withColumns({"status": status, "exclude_reason": reason}).join(scored.select("conv_id", "quality_score", "coverage_score", "final_score"), "conv_id", "left")
    named = ["conv_id", "status", "exclude_reason", "group", "problem", "cause", "support_focus", "strategy_path", "turn_count", "characters", "estimated_tokens", "normalized_hash", "quality_score", "coverage_score", "final_score"]
    return manifest(rows.select(*named), candidates, selected)


def chat_rows(recs: DataFrame, system_prompt: str) -> DataFrame:
    """``recs`` with messages that start with the system prompt; blank ones go."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt.strip()).alias("content")))
    rest = F.transform(F.filter("messages", lambda m: m["role"].isin("user", "assistant") & ~text.is_blank(m["content"])), lambda m: F.struct(m["role"].alias("role"), text.strip(m["content"]).alias("content")))
    return recs.withColumn("messages", F.concat(first, rest))


def structure_errors(recs: DataFrame, id_col: str = "conv_id", show: int = 20) -> DataFrame:
    """(rows, bad, errors): how many rows aren't system, ..., assistant with three messages or more, and the first ``show`` of them.

    ``structure_problems`` has a row for each of them.
    """
    rows = _structure(recs, id_col)
    first = rows.where("error is not null").orderBy("id").limit(show).agg(F.array_sort(F.collect_list(F.struct("id", "error"))).alias("errors"))
    return rows.agg(F.count("*").alias("rows"), F.count("error").alias("bad")).join(F.broadcast(first))


def structure_problems(recs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, error) of every row that isn't system, ..., assistant with three messages or more."""
    return _structure(recs, id_col).where("error is not null")


def _structure(recs: DataFrame, id_col: str) -> DataFrame:
    m = F.col("messages")
    problem = (
        F.when(F.coalesce(F.size(m), F.lit(0)) < 3, "too_few_messages").when(F.get(m, F.lit(0))["role"] != "system", "first_not_system")
        .when(F.element_at(m, -1)["role"] != "assistant", "last_not_assistant")
        .when(F.exists(m, lambda x: ~F.coalesce(x["role"].isin("system", "user", "assistant"), F.lit(False))), "invalid_role")
        .when(F.exists(m, lambda x: text.is_blank(x["content"])), "empty_content")
    )
    return recs.select(F.col(id_col).alias("id"), problem.alias("error"))
