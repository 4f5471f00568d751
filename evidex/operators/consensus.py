"""Consensus and contradiction among claims.

Claims are grouped by three roles; a null role value is a group of its own.
Each report has one vote per group, its most confident claim.  A group's
majority is by weight of evidence, not by number of votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.plans.claims import strength, strength_label

KEYS = ("condition", "outcome", "geometry")
DIRECTIONS = ("increase", "decrease", "no_change")


def votes(claims: DataFrame, keys=KEYS, paper: str = "paper_id") -> DataFrame:
    """The most confident claim of each report in each group; ties by direction, then weight."""
    best = Window.partitionBy(*keys, paper).orderBy(F.desc("confidence"), "direction", F.desc("w"), "fuel", "seconds")
    kept = claims.where(F.col("direction").isin(*DIRECTIONS))
    return kept.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def group_id(keys=KEYS) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys))


def groups(voted: DataFrame, keys=KEYS, scale: float = 3.0) -> DataFrame:
    """Majority, agreement, status and strength of every group of two reports or more.

    Two levels of sums: by group and direction, then by group, so a large group is added up
    where its rows lie.
    """
    sides = voted.groupBy(*keys, "direction").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    rolled = sides.groupBy(*keys).agg(
        F.sum("n").alias("n_papers"),
        F.sum("w").alias("total"),
        F.max_by(F.struct("direction", "n", "w"), F.struct("w", F.expr("case direction when 'increase' then 3 when 'decrease' then 2 else 1 end"))).alias("top"),
        *(F.sum(F.when(F.col("direction") == d, F.col("n")).otherwise(0)).alias(f"votes_{d}") for d in DIRECTIONS),
    )
    agreement = F.col("top.w").cast("double") / F.col("total").cast("double")
    minority = F.col("n_papers") - F.col("top.n")
    status = F.when((agreement >= 0.8) & (F.col("n_papers") >= 3), "consensus").when((minority >= 2) & (agreement < 0.75), "contradictory").otherwise("emerging")
    score = strength(F.col("total"), scale)
    return rolled.where("n_papers >= 2").select(
        group_id(keys).alias("id"), *keys, "n_papers", F.col("top.direction").alias("majority"), F.round(agreement, 6).alias("agreement"),
        minority.alias("minority"), status.alias("status"), F.round(score, 6).alias("strength"), strength_label(score).alias("label"), *(f"votes_{d}" for d in DIRECTIONS),
    )


def timeline(voted: DataFrame, keys=KEYS) -> DataFrame:
    """Running votes by year; years without a vote, and votes without a year, are left out."""
    yearly = voted.where(F.col("year").isNotNull()).groupBy(*keys, "year").agg(*(F.sum((F.col("direction") == d).cast("long")).alias(d) for d in DIRECTIONS))
    so_far = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly.select(group_id(keys).alias("id"), "year", *(F.sum(d).over(so_far).alias(d) for d in DIRECTIONS))


def sides(voted: DataFrame, keys=KEYS) -> DataFrame:
    """Per group and direction: votes, reports by id (least and greatest), kinds of material and the span of durations."""
    return voted.groupBy(*keys, "direction").agg(
        F.count("*").alias("n"), F.min("paper_id").alias("first_paper"), F.max("paper_id").alias("last_paper"),
        F.array_join(F.sort_array(F.collect_set(F.coalesce("fuel", F.lit("None")))), ",").alias("fuels"),
        F.max(F.col("study_type").isin("flight", "both")).alias("orbital"), F.max(F.col("study_type").isin("short_ug", "ground")).alias("earthbound"),
        F.min(F.when(F.col("seconds") > 0, F.col("seconds"))).alias("shortest"), F.max("seconds").alias("longest"),
    )


def explanations(voted: DataFrame, keys=KEYS) -> DataFrame:
    """Why contradictory groups may disagree: other materials, other gravity, or durations far apart."""
    by_side = sides(voted, keys).groupBy(*keys).agg(
        F.count_distinct("fuels").alias("n_fuels"), (F.max("orbital") & F.max("earthbound")).alias("gravity"), (F.max("longest") > 3 * F.min("shortest")).alias("durations")
    )
    hit = groups(voted, keys).where("status = 'contradictory'").select("id", *keys)
    same = [hit[k].eqNullSafe(by_side[k]) for k in keys]
    why = F.array_compact(F.array(F.when(F.col("n_fuels") > 1, "materials"), F.when(F.col("gravity"), "gravity"), F.when(F.col("durations"), "durations")))
    return hit.join(by_side, same).select("id", F.when(F.size(why) > 0, F.array_join(why, ",")).otherwise("unexplained").alias("why"))


def novelty(voted: DataFrame, last_years: int = 2, limit: int = 30, keys=KEYS) -> DataFrame:
    """Recent reports on the minority side of settled or contradictory groups of three reports or more; a top list."""
    settled = groups(voted, keys).where("status <> 'emerging' and n_papers >= 3").select("id", *keys, "majority", "n_papers")
    newest = voted.agg(F.max("year").alias("newest"))
    against = voted.join(settled, [voted[k].eqNullSafe(settled[k]) for k in keys]).where(F.col("direction") != F.col("majority"))
    return against.join(F.broadcast(newest), F.col("year") > F.col("newest") - last_years).select("id", "paper_id", "year", "direction", "majority", "n_papers").orderBy(F.desc("year"), F.desc("n_papers"), "id", "paper_id").limit(limit)


def takeaways(voted: DataFrame, topic: str = "geometry", least: int = 5, keys=KEYS) -> DataFrame:
    """Per topic: its three largest consensus and two largest contradictory groups."""
    busy = voted.groupBy(topic).agg(F.count_distinct("paper_id").alias("papers")).where(F.col("papers") >= least)
    ranked = groups(voted, keys).where("status in ('consensus', 'contradictory')").join(busy, topic, "left_semi")
    best = Window.partitionBy(topic, "status").orderBy(F.desc("n_papers"), "id")
    listed = ranked.withColumn("rank", F.row_number().over(best)).where("(status = 'consensus' and rank <= 3) or rank <= 2")
    return listed.select(topic, "status", "rank", "id", "majority", "n_papers", F.floor(F.round(F.col("agreement") * 100, 4)).cast("long").alias("percent"))


def side_rows(voted: DataFrame, keys=KEYS, least: int = 2) -> DataFrame:
    """(id, direction, paper_id, study_type, fuel, seconds, year): the votes behind each side of groups of ``least`` reports or more, a row each."""
    big = voted.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = voted.join(big, [voted[k].eqNullSafe(big[k]) for k in keys], "left_semi")
    return held.select(group_id(keys).alias("id"), "direction", "paper_id", "study_type", "fuel", "seconds", "year")


def gap_items(topic: str, bias: DataFrame, timed: DataFrame, least_seconds: float = 3600.0) -> DataFrame:
    """(topic, gap, value): what to say of a topic besides its groups: a group studied too rarely, or no duration of an hour.

    ``bias`` is :func:`coverage.group_bias`, ``timed`` is :func:`coverage.duration_gap`.
    """
    slight = bias.where("flagged").select(topic, F.lit("bias").alias("gap"), F.floor(F.round(F.col("share") * 100, 4)).cast("double").alias("value"))
    short = timed.where(F.col("longest") < least_seconds).select(topic, F.lit("duration").alias("gap"), F.col("longest").cast("double").alias("value"))
    return slight.unionByName(short.join(bias.select(topic), topic, "left_semi"))
