"""Risks: matching claims to risk definitions, evidence, countermeasures and mission briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.plans.claims import strength, strength_label


def definitions(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(risk, severity, scaled, conditions, outcomes, geometries): a fixed, short list."""
    return spark.createDataFrame(rows, "risk string, severity int, scaled boolean, conditions array<string>, outcomes array<string>, geometries array<string>")


def matched(claims: DataFrame, risks: DataFrame) -> DataFrame:
    """Claims with every risk they bear on: its condition, and its outcome or its geometry."""
    # one row per (risk, condition), so that claims meet risks by an equality; the list is fixed and short
    by_condition = risks.select("risk", "severity", "scaled", "outcomes", "geometries", F.explode("conditions").alias("condition")).dropDuplicates(["risk", "condition"])
    return claims.join(F.broadcast(by_condition), "condition").where(F.array_contains("outcomes", F.col("outcome")) | F.array_contains("geometries", F.col("geometry"))).drop("outcomes", "geometries")


def evidence(hits: DataFrame, target_fuel: str, scale: float = 12.0) -> DataFrame:
    """Per risk: reports, claims, reports on the target material, flight reports, longest duration, strength.

    A report counts with its greatest weight.
    """
    papers = hits.groupBy("risk", "paper_id").agg(F.max("w").alias("w"), F.count("*").alias("n"), F.max((F.col("fuel") == target_fuel).cast("long")).alias("material"), F.max(F.col("study_type").isin("flight", "both").cast("long")).alias("flight"), F.max("seconds").alias("longest"))
    score = strength(F.sum("w"), scale)
    return papers.groupBy("risk").agg(F.count("*").alias("n_papers"), F.sum("n").alias("n_findings"), F.sum("material").alias("n_material"), F.sum("flight").alias("n_flight"), F.max("longest").alias("longest"), F.round(score, 6).alias("strength"), strength_label(score).alias("label"))


def countermeasures(hits: DataFrame, top: int = 6) -> DataFrame:
    """Per risk the leading countermeasures, by three times the claims of an effect plus reports."""
    rolled = hits.where(F.col("countermeasure").isNotNull()).groupBy("risk", "countermeasure").agg(
        F.sum(F.when(F.col("effect") == "ineffective", 0).otherwise(1)).alias("effective"), F.sum(F.when(F.col("effect") == "ineffective", 1).otherwise(0)).alias("ineffective"), F.count_distinct("paper_id").alias("papers")
    )
    best = Window.partitionBy("risk").orderBy(F.desc(3 * F.col("effective") + F.col("papers")), "countermeasure")
    return rolled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def key_findings(hits: DataFrame, top: int = 8) -> DataFrame:
    """Per risk the reports of the greatest weight; a top list."""
    papers = hits.groupBy("risk", "paper_id").agg(F.max("w").alias("w"))
    best = Window.partitionBy("risk").orderBy(F.desc("w"), "paper_id")
    return papers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("risk", "rank", "paper_id", F.col("w").cast("double").alias("w"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def exposures(profiles: DataFrame) -> DataFrame:
    """Exposure to five conditions of each mission profile, 0 to 1."""
    each = {
        "microgravity": clamp(F.col("microgravity_days") / 180.0), "partial_gravity": clamp(F.col("partial_gravity_days") / 180.0),
        "elevated_o2": clamp((F.col("o2_percent") - 21) / 13.0), "low_pressure": clamp((101.3 - F.col("pressure_kpa")) / 44.8), "confined": F.lit(0.6),
    }
    return profiles.select("mission", "duration_days", F.explode(F.map_from_arrays(F.array(*map(F.lit, each)), F.array(*(F.round(v, 6) for v in each.values())))).alias("condition", "exposure"))


def atmosphere(profiles: DataFrame) -> DataFrame:
    """Cabin pressure in psia and partial pressure of oxygen in kPa."""
    return profiles.select("mission", F.round(F.col("pressure_kpa") / 6.895, 1).alias("psia"), F.round(F.col("pressure_kpa") * F.col("o2_percent") / 100, 1).alias("pp_o2"))


def briefing(profiles: DataFrame, risks: DataFrame, found: DataFrame) -> DataFrame:
    """Each mission's risks by priority: relevance from exposure and severity, uncertainty from the evidence.

    Priority and tier come from the rounded parts, as they are shown.
    """
    wanted = risks.select("risk", "severity", "scaled", F.explode("conditions").alias("condition"))
    most = exposures(profiles).join(F.broadcast(wanted), "condition").groupBy("mission", "risk").agg(F.max("exposure").alias("exposure"), F.max("severity").alias("severity"), F.max("scaled").alias("scaled"), F.max("duration_days").alias("days"))
    e = F.when(F.col("scaled"), F.greatest(F.col("exposure") / 2, clamp(F.col("days") / 900.0))).otherwise(F.col("exposure"))
    doubt = 1 - F.col("strength") * (0.55 + 0.25 * F.least(3 * F.col("n_material") / F.col("n_papers"), F.lit(1.0)) + 0.2 * F.least(F.col("n_flight") / 10.0, F.lit(1.0)))
    scored = most.join(found, "risk").select("mission", "risk", F.round(F.col("severity") / 5.0 * e, 3).alias("relevance"), F.round(doubt, 3).alias("uncertainty"), "n_papers", "n_material", "n_flight")
    priority = F.round(F.col("relevance") * (0.5 + 0.5 * F.col("uncertainty")), 3)
    ranked = scored.withColumn("priority", priority)
    ready = sum((c.cast("int") for c in (F.col("n_papers") >= 10, F.col("n_material") >= 3, F.col("n_flight") >= 2, F.col("uncertainty") < 0.5, F.col("relevance") < 0.5)), F.lit(0))
    return ranked.select("mission", "risk", "relevance", "uncertainty", "priority", F.when(F.col("priority") >= 0.45, "high").when(F.col("priority") >= 0.22, "medium").otherwise("low").alias("tier"), ready.alias("readiness"))
