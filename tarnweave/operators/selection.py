"""Balanced selection of records, by joins and windows over keys: strata, label coverage, caps.

A record has keys, its labels; a key may have a cap. The rules:

1. six tenths of the target keep the strata's shares (``quotas``), strata of larger
   quota first and within a stratum the records of higher score;
2. then comes, one after the other, the record of highest worth: a thousand for
   each label that no selected record has yet, ten times its coverage score, its score;
3. both under the caps: a label of a field with three labels or more is taken at most
   1.8 times its even share of the target (three times at least), and high severity
   at most 12 % of the target (once at least);
4. what is still missing is filled by score under the cap of high severity alone.

Each rule is a sequence of decisions that depend on those before. Here they are
made in rounds: whatever can be decided whatever becomes of the open decisions
before it, is decided at once. Rounds are few, each is some windows by key over
the pool's ids and keys, and the outcome is that of deciding one after the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnweave.functions import text
from tarnweave.session import drop_settled, settle

#: The share of the target that keeps the strata's shares.
KEPT_SHARE = 0.6
#: How often a label may come, against its even share; fields with fewer labels have no caps.
EVEN_TIMES, LEAST_CAP, LEAST_LABELS = 1.8, 3, 3
#: The share of high severity.
HIGH_SHARE = 0.12
HIGH = "severity\x1fhigh"


def key_of(field: Column, value: Column) -> Column:
    return F.concat_ws("\x1f", field, value)


def label_caps(labels: DataFrame, target: int) -> DataFrame:
    """(key, cap) for (field, value) pairs."""
    values = labels.select("field", "value").distinct()
    sizes = values.groupBy("field").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_LABELS) & (F.col("field") != "severity"))
    cap = F.greatest(F.lit(LEAST_CAP), F.ceil(F.lit(target) / F.col("n") * EVEN_TIMES)).cast("long")
    own = values.join(sizes, "field").select(key_of(F.col("field"), F.col("value")).alias("key"), cap.alias("cap"))
    high = values.sparkSession.createDataFrame([(HIGH, max(1, math.ceil(target * HIGH_SHARE)))], "key string, cap long")
    return own.union(high)


def stratum(records: DataFrame) -> Column:
    """The group, or the problem where all records are of one group and of several problems."""
    several = lambda c: F.count_distinct(F.coalesce(c, F.lit(""))) > 1
    one = records.agg((~several("group") & several("problem")).alias("problem")).first()
    return text.label_or(F.col("problem" if one["problem"] else "group"))


def quotas(strata: DataFrame, keep: int) -> DataFrame:
    """(stratum, quota) for (stratum, n, at): the share of ``keep``, one at least; if that is too many, the largest are cut to one level.

    What is left at that level goes, one each, to the last in the order ``at`` of those above it.
    """
    total = Window.partitionBy(F.lit(0))
    want = F.greatest(F.lit(1), F.bround(F.col("n") / F.sum("n").over(total) * keep)).cast("long")
    wanted = settle(strata.select("stratum", "at", want.alias("want")), "strata")
    # strata in rising order: cut at a level, a stratum and all above it weigh the same
    rising = Window.partitionBy(F.lit(0)).orderBy("want", "stratum")
    below, above = F.coalesce(F.sum("want").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.count("*").over(total) - F.row_number().over(rising) + 1
    level = wanted.withColumns({"below": below, "above": above}).withColumn("level", F.greatest(F.lit(1), F.floor((keep - F.col("below")) / F.col("above"))))
    # the level that holds is the first that cuts its own stratum
    cut = level.where(F.col("level") < F.col("want")).agg(F.min_by("level", F.struct("want", "stratum")).alias("level")).first()["level"]
    if cut is None:
        return wanted.select("stratum", F.col("want").alias("quota"))
    least = F.least(F.col("want"), F.lit(cut))
    spare = wanted.agg(F.greatest(F.lit(0), F.lit(keep) - F.sum(least)).alias("spare")).first()["spare"]
    late = F.row_number().over(Window.partitionBy(F.col("want") > cut).orderBy(F.desc("at")))
    return wanted.select("stratum", (least + F.when((F.col("want") > cut) & (late <= spare), 1).otherwise(0)).alias("quota"))


def admit(rows: DataFrame, keys: DataFrame, caps: DataFrame, n: int) -> DataFrame:
    """(id): the first ``n`` rows of those that come in when rows ask one after the other and none is let in beyond a cap.

    ``rows``: (id, place), ``keys``: (id, key), ``caps``: (key, cap, held). In each
    round a row comes in if its caps would hold even with all open rows before it,
    and goes if one is full of rows that came in before it.
    """
    before = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("id")
    asking = settle(keys.join(caps, "key").join(rows, "id").select("id", "place", "key", "cap", "held", F.lit(None).cast("boolean").alias("taken")), "asking")
    bound, first = asking.select("id").distinct(), asking
    while True:
        sure = F.col("held") + F.coalesce(F.sum(F.when(F.col("taken"), 1).otherwise(0)).over(before), F.lit(0))
        open_ = F.coalesce(F.sum(F.when(F.col("taken").isNull(), 1).otherwise(0)).over(before), F.lit(0))
        judged = asking.withColumns({"full": sure >= F.col("cap"), "fits": sure + open_ < F.col("cap")})
        judged = judged.withColumns({"full": F.max("full").over(mine), "fits": F.min("fits").over(mine)}).where(F.col("taken").isNotNull() | ~F.col("full"))
        after = settle(judged.select("id", "place", "key", "cap", "held", F.when(F.col("taken").isNotNull() | F.col("fits"), True).alias("taken")), "asking")
        if asking is not first:
            drop_settled(asking)
        asking = after
        if not asking.where("taken is null").limit(1).count():
            break
    admitted = rows.join(bound, "id", "left_anti").union(rows.join(asking.select("id").distinct(), "id", "left_semi"))
    return settle(admitted.orderBy("place").limit(n).select("id"), "admitted")


def cover(records: DataFrame, keys: DataFrame, caps: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(id): up to ``n`` further records that bring labels nobody chosen has, each time the one of highest worth.

    ``records``: (id, coverage_score, final_score). Worths only fall, so a record
    that is the best for each of its new labels is taken before any that could lower
    its worth, and all such records are taken in one round.
    """
    picks = None
    while True:
        have = chosen if picks is None else chosen.union(picks.select("id"))
        held = settle(keys.join(have, "id", "left_semi").groupBy("key").agg(F.count("*").alias("held")), "held")
        room = settle(keys.select("key").distinct().join(held, "key", "left").join(caps.select("key", "cap"), "key", "left").select("key", F.coalesce("held", F.lit(0)).alias("held"), "cap"), "room")
        free = keys.join(have, "id", "left_anti").join(room, "key")
        free = free.withColumn("shut", F.max(F.coalesce(F.col("held") >= F.col("cap"), F.lit(False))).over(Window.partitionBy("id"))).where("not shut")
        free = free.withColumn("gain", F.sum((F.col("held") == 0).cast("int")).over(Window.partitionBy("id"))).where("gain > 0").join(records, "id")
        worth = F.col("gain") * 1000 + F.col("coverage_score") * 10 + F.col("final_score")
        ranked = free.withColumn("place", F.struct((-worth).alias("w"), (-F.col("final_score")).alias("f"), "id"))
        k = F.row_number().over(Window.partitionBy("key").orderBy("place"))
        ranked = ranked.withColumn("k", k).withColumn("sure", ((F.col("held") > 0) | (F.col("k") == 1)) & F.coalesce(F.col("held") + F.col("k") <= F.col("cap"), F.lit(True)))
        now = settle(ranked.groupBy("id").agg(F.min("sure").alias("sure"), F.first("place").alias("place")).where("sure").select("id", "place"), "cover")
        if not now.limit(1).count():
            break
        picks = now if picks is None else settle(picks.union(now), "picks")
    if picks is None:
        return chosen.limit(0)
    return settle(picks.orderBy("place").limit(n).select("id"), "covering")


def balanced(records: DataFrame, labels: DataFrame, target: int) -> DataFrame:
    """(id): ``target`` of ``records`` (id, group, problem, coverage_score, final_score), or all if they are no more.

    ``labels``: (id, field, value). Equal scores are taken by smaller id.
    """
    records, labels = settle(records, "pool"), settle(labels.distinct(), "pool-labels")
    total = records.count()
    if total <= target:
        return records.select("id")
    keys, caps = settle(labels.select("id", key_of(F.col("field"), F.col("value")).alias("key")), "pool-keys"), settle(label_caps(labels, target), "caps")
    by_score = F.struct((-F.col("final_score")).alias("f"), F.col("id"))
    keep = int(target * KEPT_SHARE)
    in_strata = records.withColumn("stratum", stratum(records)).select("id", "stratum", by_score.alias("score"))
    # strata in the order of their best records
    shares = quotas(in_strata.groupBy("stratum").agg(F.count("*").alias("n"), F.min("score").alias("at")), keep)
    shares = settle(shares.withColumn("turn", F.struct((-F.col("quota")).alias("q"), F.col("stratum").alias("s"))), "quotas")
    of_stratum = key_of(F.lit("\x1e"), F.col("stratum"))
    rows = in_strata.join(shares, "stratum").select("id", F.struct("turn", "score").alias("place"))
    own = keys.union(in_strata.select("id", of_stratum.alias("key")))
    limits = caps.union(shares.select(of_stratum, "quota")).withColumn("held", F.lit(0).cast("long"))
    chosen = admit(rows, own, limits, keep)
    rest = lambda: records.join(chosen, "id", "left_anti")

    def limits_now(only: str | None = None) -> DataFrame:
        held = keys.join(chosen, "id", "left_semi").groupBy("key").agg(F.count("*").alias("held"))
        return settle((caps if only is None else caps.where(F.col("key") == only)).join(held, "key", "left").select("key", "cap", F.coalesce("held", F.lit(0)).alias("held")), "limits")

    def left() -> int:
        return target - chosen.count()

    if left() > 0:
        chosen = settle(chosen.union(cover(records.select("id", "coverage_score", "final_score"), keys, caps, chosen, left())), "chosen")
    if left() > 0:
        worth = F.col("coverage_score") * 10 + F.col("final_score")
        chosen = settle(chosen.union(admit(rest().select("id", F.struct((-worth).alias("w"), by_score.alias("score")).alias("place")), keys, limits_now(), left())), "chosen")
    if left() > 0:
        chosen = settle(chosen.union(admit(rest().select("id", by_score.alias("place")), keys, limits_now(HIGH), left())), "chosen")
    return chosen
