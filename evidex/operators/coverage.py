"""Coverage of a field: gap matrices, bias, durations, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLIGHT = ("flight", "both")


def matrix(claims: DataFrame, row: str, column: str, paper: str = "paper_id") -> DataFrame:
    """Distinct reports, and distinct flight reports, of each cell that has any."""
    flight = F.when(F.col("study_type").isin(*FLIGHT), F.col(paper))
    return claims.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("row"), F.col(column).alias("col")).agg(F.count_distinct(paper).alias("papers"), F.count_distinct(flight).alias("flight"))


def full_matrix(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All cells of the two vocabularies (bounded lists, one row per term), zero where there is nothing."""
    grid = rows.crossJoin(F.broadcast(columns))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("papers", "flight")))


def undercovered(cells: DataFrame, least: float = 2.0, share: float = 0.25, top: int = 8) -> DataFrame:
    """Cells far below what their row and column totals lead to expect, by deficit; a top list."""
    by_row, by_col = cells.groupBy("row").agg(F.sum("papers").alias("row_total")), cells.groupBy("col").agg(F.sum("papers").alias("col_total"))
    everything = cells.agg(F.sum("papers").alias("total"))
    grid = by_row.crossJoin(F.broadcast(by_col)).crossJoin(F.broadcast(everything))
    expected = F.col("row_total") * F.col("col_total") / F.col("total")
    full = grid.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("papers", F.lit(0)).alias("observed"), F.round(expected, 6).alias("expected"))
    flagged = full.where((F.col("expected") >= least) & (F.col("observed") <= share * F.col("expected")))
    return flagged.withColumn("deficit", F.round(F.col("expected") - F.col("observed"), 6)).orderBy(F.desc("deficit"), "row", "col").limit(top)


def row_totals(cells: DataFrame, flight_only: bool = False) -> DataFrame:
    value = "flight" if flight_only else "papers"
    totals = cells.groupBy("row").agg(F.sum(value).alias("total"))
    return totals.where("total > 0") if flight_only else totals


def group_bias(claims: DataFrame, topic: str, group: str, target: str, least: int = 5, share: float = 0.15) -> DataFrame:
    """Per topic: reports, those with the target group, its share and whether it is slight."""
    papers = claims.groupBy(topic, "paper_id").agg(F.max((F.col(group) == target).cast("int")).alias("hit"))
    rolled = papers.groupBy(topic).agg(F.count("*").alias("papers"), F.sum("hit").cast("long").alias("on_target")).where(F.col("papers") >= least)
    part = F.col("on_target") / F.col("papers")
    return rolled.select(topic, "papers", "on_target", F.round(part, 6).alias("share"), (part < share).alias("flagged"))


def group_mix(claims: DataFrame, topic: str, group: str, least: int = 5) -> DataFrame:
    """(topic, group, papers): distinct reports by group for each topic of ``least`` reports, and for all of them as topic ``overall``."""
    own = claims.select(F.col(topic).cast("string").alias("topic"), F.col(group).alias("group"), "paper_id")
    sizes = own.where("topic is not null").groupBy("topic").agg(F.count_distinct("paper_id").alias("n")).where(F.col("n") >= least)
    each = own.join(sizes, "topic", "left_semi").unionByName(own.withColumn("topic", F.lit("overall")))
    return each.where("`group` is not null").groupBy("topic", "group").agg(F.count_distinct("paper_id").alias("papers"))


def duration_gap(claims: DataFrame, topic: str, edges=(10.0, 25.0, 40.0), least: int = 3) -> DataFrame:
    """Per topic: longest, upper median and four half-open buckets of the durations.

    The upper median is picked by rank, so no group's values are gathered in one array.
    """
    timed = claims.where(F.col("seconds").isNotNull() & F.col(topic).isNotNull()).groupBy(topic, "seconds").count()
    below = Window.partitionBy(topic).orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = timed.withColumn("upto", F.sum("count").over(below)).withColumn("n", F.sum("count").over(Window.partitionBy(topic)))
    at = F.floor(F.col("n") / 2) + 1
    low, mid, high = edges
    s, k = F.col("seconds"), F.col("count")
    return (
        ranked.groupBy(topic)
        .agg(
            F.max("n").alias("n"), F.max("seconds").alias("longest"), F.min(F.when(F.col("upto") >= at, s)).alias("median"),
            F.sum(F.when(s < low, k).otherwise(0)).alias("b0"), F.sum(F.when((s >= low) & (s < mid), k).otherwise(0)).alias("b1"),
            F.sum(F.when((s >= mid) & (s < high), k).otherwise(0)).alias("b2"), F.sum(F.when(s >= high, k).otherwise(0)).alias("b3"),
        )
        .where(F.col("n") >= least)
    )


def trend(claims: DataFrame, label: str) -> DataFrame:
    """Distinct reports by label and year; reports without a year are left out."""
    return claims.where(F.col("year").isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), "year").agg(F.count_distinct("paper_id").alias("papers"))


def dense_trend(series: DataFrame) -> DataFrame:
    """Zero where a label has no report in a year in which others have."""
    grid = series.select("label").distinct().crossJoin(F.broadcast(series.select("year").distinct()))
    return grid.join(series, ["label", "year"], "left").select("label", "year", F.coalesce("papers", F.lit(0)).alias("papers"))


def cumulative(series: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("label").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return series.select("label", "year", F.sum("papers").over(so_far).alias("papers"))


def growth(series: DataFrame, least: int = 8) -> DataFrame:
    """Reports in the later half of the years, as a share of all, for labels with enough of them."""
    years = series.select("year").distinct()
    half = years.select("year", (F.ntile(2).over(Window.orderBy(F.desc("year")))).alias("half"))
    total = series.join(half, "year").groupBy("label").agg(F.sum("papers").alias("total"), F.sum(F.when(F.col("half") == 1, F.col("papers")).otherwise(0)).alias("late"))
    return total.where(F.col("total") >= least).select("label", "total", "late", F.round(F.col("late") / F.col("total"), 6).alias("late_share"))


def study_mix(claims: DataFrame) -> DataFrame:
    """Distinct reports by kind of study and year, zero-filled over both."""
    return dense_trend(trend(claims, "study_type"))


def pivoted(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A matrix for display: one column per term of a bounded list."""
    return cells.groupBy("row").pivot("col", columns).agg(F.sum("papers")).na.fill(0)
