"""Literature-based discovery: concepts that share bridges but no report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_papers(tagged: DataFrame) -> DataFrame:
    """(x, y, papers): reports in which two concepts of different kinds meet, both ways round.

    ``tagged`` has (paper, kind, concept), each once per report, and is read once: concepts meet in their report's list.
    """
    lists = tagged.where("paper is not null").groupBy("paper").agg(F.collect_list(F.struct("kind", "concept")).alias("every"))
    each = lists.select("every", F.explode("every").alias("l"))
    met = each.select("l", F.explode(F.filter("every", lambda r: r["kind"] > F.col("l.kind"))).alias("r"))
    counted = met.groupBy("l", "r").agg(F.count("*").alias("papers"))
    way = lambda l, r: F.struct(F.col(f"{l}.kind").alias("kind_x"), F.col(f"{l}.concept").alias("x"), F.col(f"{r}.kind").alias("kind_y"), F.col(f"{r}.concept").alias("y"), "papers")
    return counted.select(F.explode(F.array(way("l", "r"), way("r", "l"))).alias("p")).select("p.*")


def hypotheses(pairs: DataFrame, from_kinds: Sequence[str], to_kinds: Sequence[str], least: int = 2, keep: int = 40) -> DataFrame:
    """a and c that never meet, by the sum of their five best bridges min(ab, bc); a top list."""
    ab = pairs.where(F.col("kind_x").isin(*from_kinds)).select(F.col("x").alias("a"), F.col("kind_y").alias("kind_b"), F.col("y").alias("b"), F.col("papers").alias("n_ab"))
    bc = pairs.where(F.col("kind_y").isin(*to_kinds)).select(F.col("kind_x").alias("kind_b"), F.col("x").alias("b"), F.col("y").alias("c"), F.col("papers").alias("n_bc"))
    known = pairs.where(F.col("kind_x").isin(*from_kinds) & F.col("kind_y").isin(*to_kinds)).select(F.col("x").alias("a"), F.col("y").alias("c"))
    met = ab.join(bc, ["kind_b", "b"]).where("a <> c").join(known, ["a", "c"], "left_anti").withColumn("s", F.least("n_ab", "n_bc"))
    ranked = met.withColumn("k", F.row_number().over(Window.partitionBy("a", "c").orderBy(F.desc("s"), "b")))
    rolled = ranked.groupBy("a", "c").agg(F.count("*").alias("bridges"), F.sum(F.when(F.col("k") <= 5, F.col("s"))).alias("score"), F.min_by("b", "k").alias("best"))
    return rolled.where(F.col("bridges") >= least).orderBy(F.desc("score"), F.desc("bridges"), "a", "c").limit(keep)
