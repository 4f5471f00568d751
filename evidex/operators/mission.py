"""Mission briefings beyond the ranking: added gaps, readiness, the summary line, checks of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of readiness by number of checks passed.
LEVELS = ("not ready", "early", "early", "partial", "partial", "ready")
#: Bounds of profile fields.
BOUNDS = {"duration_days": (1, 3000), "microgravity_days": (0, 3000), "partial_gravity_days": (0, 3000), "o2_percent": (15, 100), "pressure_kpa": (20, 110)}
LONG_BURN = 3600


def gaps(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(mission, risk, gaps): the gaps of a risk and those that the mission adds, each once, in order.

    ``evidence`` has (risk, gaps, conditions, covered, longest): the conditions that belong to the risk,
    and those that some report covers.  Both tables are short lists.
    """
    lacks = lambda c: F.array_contains("conditions", c) & ~F.array_contains("covered", c)
    more = F.array_compact(
        F.array(
            F.when((F.col("partial_gravity_days") > 0) & lacks("partial_gravity"), "partial gravity is not measured"),
            F.when((F.col("o2_percent") > 24) & lacks("elevated_o2"), "elevated oxygen is not measured"),
            F.when(F.coalesce("longest", F.lit(0)) < LONG_BURN, "no long burn in orbit"),
        )
    )
    # every risk of a fixed list concerns every profile
    both = profiles.withColumn("_k", F.lit(1)).join(F.broadcast(evidence.withColumn("_k", F.lit(1))), "_k")
    return both.select("mission", "risk", F.array_distinct(F.concat("gaps", more)).alias("gaps"))


def readiness(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(mission, risk, level, label): five checks of the evidence.

    ``evidence`` has (risk, n_papers, strength, n_material, n_flight, longest, partial, effective).
    """
    checks = [
        (F.col("n_papers") >= 10) & (F.col("strength") >= 0.5), (F.col("n_material") >= 3) & (F.col("n_flight") >= 3), F.coalesce("longest", F.lit(0)) >= LONG_BURN,
        F.coalesce("partial", F.lit(False)) | (F.coalesce("partial_gravity_days", F.lit(0)) == 0), F.coalesce("effective", F.lit(0)) > 0,
    ]
    level = sum((c.cast("int") for c in checks), F.lit(0))
    both = profiles.withColumn("_k", F.lit(1)).join(F.broadcast(evidence.withColumn("_k", F.lit(1))), "_k").withColumn("level", level)
    return both.select("mission", "risk", "level", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("label"))


def narrative(briefing: DataFrame) -> DataFrame:
    """(mission, top, thin): up to three risks of the high tier, else the first two, and three relevant ones on few materials.

    ``briefing`` has (mission, risk, priority, relevance, tier, n_material): a row per risk of a short list.
    """
    order = lambda x: F.transform(F.array_sort(x), lambda y: y["risk"])
    item = F.struct((-F.col("priority")).alias("p"), F.col("risk"))
    rolled = briefing.groupBy("mission").agg(F.collect_list(F.when(F.col("tier") == "high", item)).alias("high"), F.collect_list(item).alias("every"), F.collect_list(F.when((F.col("relevance") >= 0.3) & (F.col("n_material") < 3), item)).alias("thin"))
    top = F.when(F.size("high") > 0, F.slice(order("high"), 1, 3)).otherwise(F.slice(order("every"), 1, 2))
    return rolled.select("mission", F.array_join(top, ", ").alias("top"), F.array_join(F.slice(order("thin"), 1, 3), ", ").alias("thin"))


def invalid_fields(profiles: DataFrame) -> DataFrame:
    """(mission, field, value): fields that are missing or out of bounds."""
    bad: list[Column] = []
    for name, (low, high) in BOUNDS.items():
        v = F.col(name).cast("double")
        bad.append(F.when(v.isNull() | ~v.between(low, high), F.struct(F.lit(name).alias("field"), v.alias("value"))))
    return profiles.select("mission", F.explode(F.array_compact(F.array(*bad))).alias("x")).select("mission", "x.*")
