"""The claims table: findings of a literature, bound to a star schema.

A claim says in which direction an outcome went under a condition, in which
report (``paper_id``), how sure the statement is and how strong the study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight of evidence by kind of study and by kind of material.
STUDY_WEIGHTS = {"flight": "1.0", "both": "1.0", "short_ug": "0.7", "ground": "0.5", "computational": "0.3", "review": "0.2"}
FUEL_WEIGHTS = {"STEEL": "1.0", "COPPER": "0.8"}
DEFAULT_STUDY, DEFAULT_FUEL = "0.5", "0.6"
STUDY_OF_PRIORITY = {"1-URGENT": "flight", "2-HIGH": "both", "3-MEDIUM": "short_ug", "4-NOT SPECIFIED": "ground", "5-LOW": "computational"}
DIRECTION_OF_FLAG = {"R": "increase", "A": "decrease", "N": "no_change"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: Column, values: dict, default=None) -> Column:
    """A lookup in a small fixed table, as one expression."""
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def weight(study: str = "study_type", fuel: str = "fuel", confidence: str = "confidence") -> Column:
    """Study weight times material weight times (0.5 + 0.5 confidence), exact in decimals."""
    s = mapped(F.col(study), STUDY_WEIGHTS, DEFAULT_STUDY).cast("decimal(3,1)")
    f = mapped(F.element_at(F.split(F.col(fuel), " "), -1), FUEL_WEIGHTS, DEFAULT_FUEL).cast("decimal(3,1)")
    return (s * f * (F.lit("0.5").cast("decimal(2,1)") + F.lit("0.5").cast("decimal(2,1)") * F.col(confidence))).cast("decimal(12,6)")


def strength(w: Column, scale: float = 3.0) -> Column:
    """1 - exp(-W / scale)."""
    return 1 - F.exp(-w.cast("double") / scale)


def strength_label(score: Column) -> Column:
    return F.when(score >= 0.75, "strong").when(score >= 0.45, "moderate").when(score > 0, "limited").otherwise("none")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim; the sides joined to the fact table are matched by key."""
    line, part, orders, customer = (read(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    rows = joined.select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_linenumber").alias("line"),
        F.year("o_orderdate").alias("year"),
        mapped(F.col("o_orderpriority"), STUDY_OF_PRIORITY).alias("study_type"),
        F.col("p_brand").alias("condition"),
        F.col("p_size").cast("string").alias("outcome"),
        F.col("c_mktsegment").alias("geometry"),
        F.col("p_type").alias("fuel"),
        mapped(F.col("l_returnflag"), DIRECTION_OF_FLAG).alias("direction"),
        F.concat(F.lit("cm"), (F.col("c_nationkey") % 11).cast("string")).alias("countermeasure"),
        F.when(F.col("l_linestatus") == "F", "ineffective").otherwise("effective").alias("effect"),
        (F.lit("0.5").cast("decimal(2,1)") + 5 * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(6,2)").alias("confidence"),
        F.col("l_quantity").alias("seconds"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_partkey").alias("partkey"),
    )
    return rows.withColumn("w", weight())


#: Claims of a part that :func:`by_paper` deals out.
PART_ROWS = 250_000


def by_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`claims` with those of a report in one part, in parts of some ``PART_ROWS``, however many there are.

    What counts distinct reports holds about a row for each claim and edge, so a task's memory follows from its claims.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, "lineitem").count() // PART_ROWS))
    return claims(spark, sf_dir).repartition(parts, "paper_id")


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


_quoted = {k: f"'{v}'" for k, v in STUDY_OF_PRIORITY.items()}
CLAIMS_SQL = f"""
claims AS (
  SELECT *, CAST(CAST({_case("study_type", STUDY_WEIGHTS, DEFAULT_STUDY)} AS DECIMAL(3,1))
       * CAST({_case("split_part(fuel, ' ', -1)", FUEL_WEIGHTS, DEFAULT_FUEL)} AS DECIMAL(3,1))
       * (CAST(0.5 AS DECIMAL(2,1)) + CAST(0.5 AS DECIMAL(2,1)) * confidence) AS DECIMAL(12,6)) AS w
  FROM (
    SELECT l_orderkey AS paper_id, l_linenumber AS line, year(o_orderdate) AS year,
           {_case("o_orderpriority", _quoted, "NULL")} AS study_type,
           p_brand AS condition, CAST(p_size AS VARCHAR) AS outcome, c_mktsegment AS geometry, p_type AS fuel,
           {_case("l_returnflag", {k: f"'{v}'" for k, v in DIRECTION_OF_FLAG.items()}, "NULL")} AS direction,
           'cm' || CAST(c_nationkey % 11 AS VARCHAR) AS countermeasure,
           CASE WHEN l_linestatus = 'F' THEN 'ineffective' ELSE 'effective' END AS effect,
           CAST(CAST(0.5 AS DECIMAL(2,1)) + 5 * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(6,2)) AS confidence,
           l_quantity AS seconds, l_suppkey AS suppkey, l_partkey AS partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))
"""
