"""Evaluation: ranking metrics, stage baselines, stratified samples, precision by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(hits: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: hit at 1, 3, 5, 10, reciprocal rank, precision at 5 (or at the number of hits, if fewer).

    ``relevant`` has distinct (query, doc); every query of ``queries`` counts, with zeros if it has no hits.
    """
    judged = hits.where("rank <= 10").join(relevant.withColumn("good", F.lit(1)), ["query", "doc"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    each = queries.select("query").join(judged, "query", "left")
    at = lambda k: F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("good")).otherwise(0)), F.lit(0))
    shown = F.least(F.lit(5), F.greatest(F.count("rank"), F.lit(1)))
    return each.groupBy("query").agg(*(at(k).alias(f"hit{k}") for k in (1, 3, 5, 10)), F.round(F.coalesce(1 / F.min(F.when(F.col("good") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.sum(F.when(F.col("rank") <= 5, F.col("good")).otherwise(0)), F.lit(0)) / shown, 6).alias("p5"))


def by_paper(hits: DataFrame, papers: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, rank): the papers of each query's first ``k`` passages in order, each once; ``papers`` has (doc, paper)."""
    first = hits.where(F.col("rank") <= k).join(papers, "doc").groupBy("query", "paper").agg(F.min("rank").alias("first"))
    return first.select("query", F.col("paper").alias("doc"), F.row_number().over(Window.partitionBy("query").orderBy("first", "paper")).alias("rank"))


def baselines(metrics: DataFrame, mode: str = "mode") -> DataFrame:
    """Means of the metrics by retrieval mode."""
    return metrics.groupBy(mode).agg(*(F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hit3", "hit5", "hit10", "rr", "p5")))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """A sample of n rows that takes the strata in turn, in the order of a hash; a sampling operator."""
    turn = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("turn", F.row_number().over(turn)).orderBy("turn", stratum).limit(n)


def field_precision(labels: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, yes, no, precision): blanks don't count."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields))).alias("x")
    rolled = labels.select(each).groupBy(F.col("x.field").alias("field")).agg(F.count_if(F.col("x.v") == 1).alias("yes"), F.count_if(F.col("x.v") == 0).alias("no"))
    return rolled.select("field", "yes", "no", F.round(F.col("yes") / (F.col("yes") + F.col("no")), 6).alias("precision"))
