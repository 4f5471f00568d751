"""Experiments: envelope, nearest neighbours by class, distinct reports, sweeps, and classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.extract import numbers
from evidex.operators.retrieval import QUERIES_AT_ONCE, ROWS_AT_ONCE, TILE, blocks

#: Kilopascals per unit.
KPA = {"kPa": 1.0, "psi": 6.89476, "atm": 101.325, "bar": 100.0}


def to_kpa(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, f in KPA.items():
        out = F.when(unit == k, value * f).otherwise(out)
    return out


def regime(quote: Column) -> Column:
    no, yes = F.lower(quote).rlike("no spread|extinguish|did not"), F.lower(quote).rlike("spread|propagat|grow")
    return F.when(no & yes, "marginal").when(no, "no_spread").when(yes, "spread")


def envelope(rows: DataFrame, fields: Sequence[str], pad: float = 1.0) -> DataFrame:
    """(field, low, high): the range of each measured field, padded, zero at least."""
    stats = rows.agg(*(f(c).alias(f"{c}_{n}") for c in fields for n, f in (("low", F.min), ("high", F.max))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.greatest(F.col(f"{c}_low") - pad, F.lit(0.0)).alias("low"), (F.col(f"{c}_high") + pad).alias("high")) for c in fields)))
    return stats.select(each.alias("x")).select("x.*")


def inside(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(point, inside): whether every field of a point lies within its range; points are (point, field, value)."""
    return points.join(F.broadcast(ranges), "field").groupBy("point").agg(F.min(((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).cast("int")).alias("ok")).select("point", (F.col("ok") == 1).alias("inside"))


def _ranks(ids: pa.Array) -> np.ndarray:
    """The place of each value in ascending order."""
    ranks = np.empty(len(ids), np.int64)
    ranks[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return ranks


def knn_votes(rows: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """(query, label, share): classes of the k nearest, weighing 1 / (distance + .001).

    ``queries`` (query, qv) is a stated set; nobody is their own neighbour.  Blocks of rows meet blocks of queries in
    matrix products, which leave out what is surely too far; the Euclidean distance of the rest is summed in order, in double
    precision, and a block hands on its k nearest for each query.  Vectors that are null, hold nulls or have another
    length than the query's take no part.
    """
    whole = lambda df, *kept: df.select(*kept, F.col("v").cast("array<double>").alias("v")).where("v is not null and forall(v, x -> x is not null)").withColumn("d", F.size("v"))
    left, right = blocks(whole(rows.where("id is not null"), "id", "label"), whole(queries.where("query is not null").withColumnRenamed("qv", "v"), "query"), "id", ROWS_AT_ONCE, QUERIES_AT_ONCE)
    kinds = dict(left.dtypes) | {"query": dict(right.dtypes)["query"]}

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, labels, names = (t.column(c).combine_chunks() for t, c in ((rows, "id"), (rows, "label"), (asked, "query")))
        which, places, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(asked):
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            x, q, rank = matrix(rows), matrix(asked), _ranks(ids)
            own, called = (a.to_numpy(zero_copy_only=False) for a in (ids, names))
            with np.errstate(all="ignore"):
                squares, columns = (x * x).sum(axis=1), np.ascontiguousarray(x.T)
                for at in range(0, len(q), TILE):
                    some = q[at : at + TILE]
                    lengths = (some * some).sum(axis=1)
                    about = lengths[:, None] + squares - 2 * (some @ x.T)
                    slack = 1e-10 * (lengths + squares.max())  # far more than the rounding of the products
                    for i, near in enumerate(about):
                        # the k + 1 nearest, as the query's own row may be one; what isn't a number stays in
                        here = np.arange(len(near)) if len(near) <= k + 1 else np.flatnonzero(~(near > np.partition(near, k)[k] + 2 * slack[i]))
                        here = here[own[here] != called[at + i]]
                        d = np.zeros(len(here))
                        for column, c in zip(columns, some[i], strict=True):
                            d += (column[here] - c) * (column[here] - c)
                        d = np.sqrt(d)
                        first = np.lexsort((rank[here], d))[:k]
                        which.append(np.full(len(first), at + i))
                        places.append(here[first])
                        apart.append(d[first])
        which, places = np.concatenate(which), np.concatenate(places)
        return pa.table({"query": names.take(pa.array(which)), "id": ids.take(pa.array(places)), "label": labels.take(pa.array(places)), "d": np.concatenate(apart)})

    key = ("_b", "_q", "d")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, f"query {kinds['query']}, id {kinds['id']}, label {kinds['label']}, d double")
    nearest = Window.partitionBy("query").orderBy("d", "id")
    kept = near.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).withColumn("w", 1 / (F.col("d") + 1e-3))
    sums = kept.groupBy("query", "label").agg(F.sum("w").alias("w"))
    return sums.select("query", "label", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query")), 6).alias("share"))


def least_of_each(rows: DataFrame, value: str, most: int) -> DataFrame:
    """Of the rows with one value, not null, those of the ``most`` least ids: all of them that can be nearest to anything.

    They are found where the rows lie, so that no more than these are sorted and shuffled.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            both = pa.Table.from_batches([batch] if kept is None else [batch, *kept.to_batches()]).combine_chunks()
            code = both.column(value).combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((_ranks(both.column("id").combine_chunks()), code))
            begins = np.searchsorted(code[order], code[order])
            now = both.take(pa.array(order[np.arange(len(order)) - begins < most]))
            if len(now) > max(1_000_000, 100 * most):  # too many values to hold
                yield from now.to_batches()
                now = None
            kept = now
        if kept is not None:
            yield from kept.to_batches()

    some = rows.where(F.col(value).isNotNull() & F.col("id").isNotNull())
    order = Window.partitionBy(value).orderBy("id")
    return some.mapInArrow(least, some.schema).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def nearest_reports(rows: DataFrame, query: Sequence[float], fields: Sequence[str], scales: Sequence[float], material: str, top: int = 3) -> DataFrame:
    """The nearest experiments of distinct reports; another material costs one half."""
    d = F.when(F.col("material") == material, F.lit(0.0)).otherwise(F.lit(0.5))
    for f, q, s in zip(fields, query, scales, strict=True):
        d = d + F.pow((F.col(f) - q) / s, 2)
    own = rows.groupBy("report").agg(F.min(F.round(d, 6)).alias("d"))
    return own.orderBy("d", "report").limit(top)


def sweep(model: DataFrame, low: float, high: float, points: int = 26) -> DataFrame:
    """A grid of values against the envelope: which can be predicted."""
    spark = model.sparkSession
    grid = spark.range(points).select(F.col("id").cast("int").alias("i"), F.round(low + F.col("id") * ((high - low) / (points - 1)), 6).alias("value"))
    return grid.crossJoin(F.broadcast(model)).select("i", "value", F.col("value").between(F.col("low"), F.col("high")).alias("inside"))


def one_hot(column: Column, values: Sequence[str]) -> Column:
    """Fixed positions, the last for anything else."""
    return F.array(*((column == v).cast("int") for v in values), (~F.coalesce(column.isin(*values), F.lit(False))).cast("int"))


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, classes: int, trees: int = 20):
    """One boosted forest per class (Spark's boosting is binary)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    boosted = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.08, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), OneVsRest(classifier=boosted, labelCol=label, featuresCol="features")]).fit(train)


def training_subset(experiments: DataFrame, conditions: Sequence[str], least: int = 40) -> DataFrame:
    """Rows with a measured or unusual atmosphere, or a condition that tells one; all rows where these are fewer than ``least``."""
    fit = F.coalesce(F.col("measured"), F.lit(False)) | F.coalesce(F.col("condition").isin(*conditions), F.lit(False)) | F.coalesce(F.abs(F.col("oxygen") - 21) > 0.5, F.lit(False))
    enough = experiments.where(fit).limit(least).count() >= least
    return experiments.where(fit) if enough else experiments


def first_measured(texts: Sequence[Column], pattern: str, low: float, high: float) -> Column:
    """The first value within bounds in the texts, taken in turn; null if none is."""
    return F.get(numbers(F.concat_ws(" ", *texts), pattern, low, high), F.lit(0))


#: Patterns of stated atmospheres: per cent of oxygen, and a number with its unit of pressure.
OXYGEN = r"(\d+(?:\.\d+)?)\s*%\s*(?:O2|oxygen)"
PRESSURE = r"(\d+(?:\.\d+)?\s*(?:kPa|psi|atm|bar))\b"


def stated_kpa(text: Column, low: float = 5.0, high: float = 2000.0) -> Column:
    """The first pressure of 5 to 2000 kPa that a text states, in kPa."""
    in_kpa = lambda m: to_kpa(F.regexp_extract(m, r"^(\d+(?:\.\d+)?)", 1).cast("double"), F.regexp_extract(m, "([A-Za-z]+)$", 1))
    found = F.transform(F.regexp_extract_all(text, F.lit(PRESSURE), F.lit(1)), in_kpa)
    return F.get(F.filter(found, lambda v: v.between(low, high)), F.lit(0))


def regime_of(outcome: Column, quote: Column, by_outcome: Mapping[str, str]) -> Column:
    """The quote's regime, else that of the outcome; null for outcomes that tell of no spread."""
    silent = F.lit(None).cast("string")
    for k, v in by_outcome.items():
        silent = F.when(outcome == k, v).otherwise(silent)
    return F.when(outcome.isin(*by_outcome), F.coalesce(regime(quote), silent))


def experiment_rows(findings: DataFrame, papers: DataFrame, by_outcome: Mapping[str, str], typical: Mapping[str, tuple[float, float, float]], usual: tuple[float, float, float] = (21.0, 101.3, 5.0)) -> DataFrame:
    """One row per finding that tells a regime: oxygen and pressure as stated in the report's atmosphere, the quote or
    the abstract, else typical of the condition; flow by condition, at least 8 in a moving flow, 0 in a still one.

    ``findings`` has (finding, paper, condition, outcome, geometry, fuel, quote), ``papers`` (paper, atmosphere, abstract).
    """
    met = findings.join(papers, "paper").withColumn("regime", regime_of(F.col("outcome"), F.col("quote"), by_outcome)).where("regime is not null")
    said = [F.coalesce(c, F.lit("")) for c in ("atmosphere", "quote", "abstract")]
    oxygen, pressure = first_measured(said, OXYGEN, 10, 100), stated_kpa(F.concat_ws(" ", *said))

    def typically(k: int) -> Column:
        out = F.lit(usual[k])
        for condition, values in typical.items():
            out = F.when(F.col("condition") == condition, values[k]).otherwise(out)
        return out

    moving, still = F.col("geometry").rlike("opposed|concurrent"), F.col("geometry").rlike("quiescent|candle")
    flow = F.when(moving, F.greatest(typically(2), F.lit(8.0))).when(still, 0.0).otherwise(typically(2))
    source = lambda c: F.when(c.isNotNull(), "measured").otherwise("imputed")
    return met.select(
        "finding", "paper", "condition", "outcome", "fuel", "regime", F.round(F.coalesce(oxygen, typically(0)), 3).alias("oxygen"), F.round(F.coalesce(pressure, typically(1)), 3).alias("pressure"),
        F.round(flow, 3).alias("flow"), source(oxygen).alias("oxygen_source"), source(pressure).alias("pressure_source"),
    )


def scaled(rows: DataFrame, column: str = "v") -> DataFrame:
    """``rows`` with each component of a vector column divided by its standard deviation over all rows; a constant component stays as it is."""
    each = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.stddev_pop(F.col("x").cast("double")).alias("s"))
    sizes = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: F.when(p["s"] > 0, p["s"]).otherwise(1.0)).alias("_sd"))
    # one row of as many numbers as a vector has components
    return rows.crossJoin(F.broadcast(sizes)).withColumn(column, F.zip_with(column, "_sd", lambda x, s: x.cast("double") / s)).drop("_sd")


def voted_classes(votes: DataFrame) -> DataFrame:
    """(query, predicted, share): the class of the greatest share in :func:`knn_votes`, ties to the least."""
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("share")).alias("s"), "label")).alias("m")).select("query", F.col("m.label").alias("predicted"), (-F.col("m.s")).alias("share"))


def confusion(told: DataFrame) -> DataFrame:
    """(label, predicted, n) of rows with both."""
    return told.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def folds(rows: DataFrame, label: str, key: str, n: int = 5) -> DataFrame:
    """Adds ``fold``: the rows of each class dealt in turn, in the order of a hash of their key."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % n).cast("int"))


def cross_validated(rows: DataFrame, features: Sequence[str], label: str, key: str, classes: int, n: int = 5, trees: int = 20) -> DataFrame:
    """(label, predicted, n): each fold predicted by boosted forests of the others; the folds are stratified."""
    dealt = folds(rows, label, key, n)
    told = None
    for k in range(n):
        model = fit_boosted(dealt.where(F.col("fold") != k), features, label, classes, trees)
        part = model.transform(dealt.where(F.col("fold") == k)).select(F.col(label).alias("label"), F.col("prediction").cast("int").alias("predicted"))
        told = part if told is None else told.unionByName(part)
    return confusion(told)
