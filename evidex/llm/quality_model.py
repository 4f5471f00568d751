"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes a row of statistics of its whole text; random Fourier
features approximate a Gaussian kernel over the standardised statistics.  Each
partition of the labelled rows sums its part of the normal equations; Spark
adds the parts entry by entry, and only the finished matrix (features squared)
reaches the driver, where it is solved.  Two folds score each other's rows;
the scores' histogram, with the labels' sums, is fitted by pool-adjacent-
violators, which turns ridge scores into calibrated probabilities.

Cases: null and empty texts have all statistics zero and get a score like any
other row; rows repeat freely; labels that repeat for an id are averaged, null
labels and labels without a document are ignored; with no usable label the
score is one half everywhere; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import bounded_batches, checkpointed, held_out, id_bucket, table

FEATURES = 160
RIDGE = 1e-3
GAMMA = 0.06
BINS = 400
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r", b".,;:?'\"()-", b"!", b"#*$%&<>", b"|", b"@/_=+~^\\`[]{}")):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = 12
N_STATS = 21


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one whole text."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=13)
    out[:12] = np.sqrt(by_class[1:] / len(raw))
    words = text.split()
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out[12] = sizes.mean() / 5
        out[13] = sizes.std() / 5
        out[14] = (sizes <= 3).mean()
        out[15] = (sizes >= 15).mean()
        out[16] = len(set(words)) / len(words) ** 0.85
        out[17] = np.log1p(len(words)) / 5
    lines = text.split("\n")
    out[18] = len(set(lines)) / len(lines)
    out[19] = np.log1p(len(raw) / len(lines)) / 5
    share = by_byte[by_byte > 0] / len(raw)
    out[20] = -(share * np.log2(share)).sum() / 5
    return out


def with_statistics(docs: DataFrame, text_col: str, carry: dict[str, str]) -> DataFrame:
    """The columns of ``carry`` (name to input column) and ``stats`` array<double>."""
    names = list(carry)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            stats = np.array([statistics(t) for t in texts]).reshape(-1)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(stats))], [*names, "stats"])

    picked = bounded_batches(docs).select(*(docs[c].alias(n) for n, c in carry.items()), docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return picked.mapInArrow(compute, schema)


class Model:
    """Standardisation, Fourier features, ridge weights and calibration."""

    def __init__(self, mean, spread, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean), np.asarray(spread)
        self.freq = rng.standard_normal((N_STATS, FEATURES)) * np.sqrt(2 * GAMMA)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.folds: list[np.ndarray] = []
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.freq + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, *self.knots)


def _stats_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy().reshape(-1, N_STATS)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``values`` by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(rows: DataFrame) -> Model:
    """``rows``: fold int (0 or 1), y double, stats array<double>, all labelled training rows."""
    sums = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    if not sums:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model([r["m"] for r in sums], [max(r["s"], 1e-3) for r in sums])
    size = FEATURES + 2  # the last row and column hold the products with y
    upper = np.triu_indices(size)
    start = model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for batch in batches:
            x = np.hstack([start.features(_stats_of(batch, "stats")), batch.column(1).to_numpy()[:, None]])
            fold = batch.column(0).to_numpy()
            for k in (0, 1):
                part = x[fold == k]
                total[k] += part.T @ part
        for k in (0, 1):
            if total[k].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[k][upper])], ["fold", "i", "j", "v"])

    added = rows.select("fold", "y", "stats").mapInArrow(normal, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    grams = np.zeros((2, size, size))
    for r in added.toLocalIterator():
        grams[r["fold"], r["i"], r["j"]] = grams[r["fold"], r["j"], r["i"]] = r["v"]

    def solve(gram: np.ndarray) -> np.ndarray:
        n = max(gram[-2, -2], 1.0)
        a = gram[:-1, :-1] + RIDGE * n / FEATURES * np.eye(size - 1)
        return np.linalg.solve(a, gram[:-1, -1])

    model.weights, model.folds = solve(grams.sum(axis=0)), [solve(grams[1]), solve(grams[0])]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((3, BINS))
        for batch in batches:
            x, y, fold = model.features(_stats_of(batch, "stats")), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            raw = np.where(fold == 0, x @ model.folds[0], x @ model.folds[1])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            for k, w in enumerate((np.ones(len(y)), y, raw)):
                seen[k] += np.bincount(at, weights=w, minlength=BINS)
        some = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in seen)], ["bin", "n", "y", "x"])

    bins = rows.select("fold", "y", "stats").mapInArrow(histogram, "bin int, n double, y double, x double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("x").alias("x")).orderBy("bin").collect()
    n, y, x = (np.array([r[c] for r in bins]) for c in ("n", "y", "x"))
    # half a row of either label keeps the ends off certainty
    fitted = pool_adjacent((y + 0.5 * y.sum() / n.sum()) / (n + 0.5), n)
    model.knots = (x / n, np.clip(fitted, 0.0, 1.0))
    return model


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, label_id: str) -> DataFrame:
    """(fold, y, stats) of labelled rows that are not held out; folds by the id."""
    named = labels.groupBy(F.col(label_id).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).where("y is not null")
    bucket = id_bucket("_id")
    return stats.where(~held_out(id_col)).join(named, F.col(id_col) == F.col("_id")).select(F.when(bucket == 3, F.pmod(F.xxhash64("_id"), F.lit(2))).otherwise(bucket).cast("int").alias("fold"), "y", "stats")


def score_rows(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of rows that hold ``stats``, and ``score``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(_stats_of(batch, "stats")))], [*keep, "score"])

    picked = rows.select(*keep, "stats")
    return picked.mapInArrow(apply, T.StructType([*picked.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns of ``docs``."""
    stats = with_statistics(docs, text_col, {"doc_id": id_col})
    model = fit(checkpointed(training_rows(stats, labels, "doc_id", label_col, id_col)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, N_STATS)
            yield batch.filter(pa.array(shared.value.score(stats) >= threshold))

    return docs.mapInArrow(choose, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    stats = checkpointed(with_statistics(docs, "text", {"doc_id": "doc_id"}))
    model = fit(checkpointed(training_rows(stats, table(spark, sf_dir, "labels"), "doc_id", "quality", "doc_id")))
    scored = score_rows(stats, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
