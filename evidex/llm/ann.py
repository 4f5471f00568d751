"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation: principal axes, then
alternating sign codes and orthogonal Procrustes steps) turn vectors into binary codes.
A code is split into substrings of 16 bits, of which the first ``tables`` are indexed:
rows are dealt by substring number and leading bits of its value, and sorted by value.
A query goes to the groups that probing can reach and looks up every value that differs
in at most ``reach`` bits, substring by substring.  By the pigeonhole principle this
retrieves every code that differs in fewer than tables * (reach + 1) indexed bits, and
by chance many more; what is retrieved is filtered by the Hamming distance of whole
codes, told once, by the first substring that finds it, and reranked by exact cosine on the original vectors.  Reach, tables and radius
are fitted on the sample, to find a stated share of the sample's own neighbours.

Equal vectors are searched once, as one entry with its smallest ids; groups with more
rows than most are split, and queries sent to each part.  A query for which fewer than k
rows were found is answered from all rows, in blocks of queries (the exact way).

Cases: null, empty, zero and non-finite vectors, those of another length than
the most usual one, and rows without an id take no part; a query's own id is no
candidate, however often its row repeats; ties go to the smaller id; of rows that
repeat an id the least vector counts; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import checkpointed, table

SUBSTRING_BITS = 16
#: Substrings of a whole code.
SUBSTRINGS = 32
#: Rows aimed at per group of the index.
GROUP_ROWS = 32_768
#: Values and codes compared at once.
AT_ONCE = 1 << 20


class Codes:
    """Learned rotations; packs sign bits into substrings of 16."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray):
        self.mean, self.rotation = mean, rotation
        self.reach, self.tables, self.radius = SUBSTRING_BITS, 1, rotation.shape[1]  # finds all

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) of uint16."""
        bits = (self.unit(x) - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def fit_codes(sample: np.ndarray, rounds: int = 15, k: int = 5, share: float = 0.93, queries: int = 500, seed: int = 7) -> Codes:
    """ITQ on the sample; bits beyond the dimension come from further rotations, each refined likewise."""
    x = Codes.unit(sample)
    d = x.shape[1]
    mean = x.mean(axis=0)
    centred = x - mean
    rng = np.random.default_rng(seed)
    axes = np.linalg.svd(centred.T @ centred)[2]
    parts, left = [], SUBSTRINGS * SUBSTRING_BITS
    while left > 0:
        width = min(d, left)
        base = axes.T[:, :width]
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        v = centred @ base
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        parts.append(base @ turn)
        left -= width
    codes = Codes(mean, np.hstack(parts))
    packed = codes.encode(sample)
    apart = []  # bits in which near pairs differ, by substring
    for q in rng.permutation(len(x))[:queries]:
        near = np.argpartition(-(x @ x[q]), min(k, len(x) - 1))[: k + 1]
        apart.append(np.bitwise_count(packed[near] ^ packed[q])[near != q])
    apart = np.concatenate(apart)
    if not len(apart):
        return codes
    codes.radius = int(np.quantile(apart.sum(axis=1), 0.99, method="higher"))
    inside = apart.sum(axis=1) <= codes.radius
    for codes.reach in range(SUBSTRING_BITS + 1):
        found = np.logical_or.accumulate(apart <= codes.reach, axis=1)
        enough = np.flatnonzero((found & inside[:, None]).mean(axis=0) >= share)
        if len(enough):
            codes.tables = int(enough[0]) + 1
            break
    return codes


def masks(bits: int, flips: int) -> np.ndarray:
    """All values of ``bits`` bits of which at most ``flips`` are set."""
    every = np.arange(1 << bits, dtype=np.uint32)
    return every[np.bitwise_count(every) <= flips].astype(np.uint16)


def probe(values: np.ndarray, codes: np.ndarray, asked: np.ndarray, asked_codes: np.ndarray, prefix: int, lead: int, reach: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) places: rows of a group whose value differs from the query's in at most ``reach`` bits, and whose code lies within the radius.

    ``values`` ascend and all begin with the ``lead`` bits of ``prefix``.
    """
    low = SUBSTRING_BITS - lead
    used = np.bitwise_count((asked >> low) ^ np.uint16(prefix)).astype(np.int64)
    for spent in np.unique(used[used <= reach]).tolist():
        flips = masks(low, reach - spent)
        here = np.flatnonzero(used == spent)
        step = max(1, AT_ONCE // len(flips))
        for at in range(0, len(here), step):
            some = here[at : at + step]
            wanted = (np.uint16(prefix << low) | ((asked[some] & np.uint16((1 << low) - 1))[:, None] ^ flips)).reshape(-1)
            begin, end = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            counts, owner = end - begin, np.repeat(some, len(flips))
            hit = np.flatnonzero(counts)
            begin, counts, owner = begin[hit], counts[hit], owner[hit]
            bounds = np.searchsorted(np.cumsum(counts), np.arange(AT_ONCE, int(counts.sum()) + AT_ONCE, AT_ONCE))
            first = 0
            for last in np.unique(np.append(bounds + 1, len(counts))).tolist():
                n = counts[first:last]
                if n.sum():
                    row = np.repeat(begin[first:last] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    query = np.repeat(owner[first:last], n)
                    near = np.bitwise_count(codes[row] ^ asked_codes[query]).sum(axis=1, dtype=np.int64) <= radius
                    yield query[near], row[near]
                first = last


def first_found(some: np.ndarray, others: np.ndarray, part: int, reach: int) -> np.ndarray:
    """Whether no substring before ``part`` retrieves the pairs of codes, which rows of 64-bit words hold."""
    before = np.bitwise_count(some.view(np.uint16)[:, :part] ^ others.view(np.uint16)[:, :part])
    return (before > reach).all(axis=1)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine in double precision, each row by the same order of operations, so equal vectors tie exactly."""
    return (rows * query).sum(axis=-1) / (np.sqrt((rows * rows).sum(axis=-1)) * np.sqrt((query * query).sum(axis=-1)))


def _usable(vec: str, dim: int) -> Column:
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top(df: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, sample_rows: int = 20_000, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest rows found, nearest first."""
    spark = rows.sparkSession
    out = f"query_id bigint, rank int, {id_col} bigint, score double"
    usual = rows.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], out)
    as_vectors = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable("v", usual["d"])).groupBy("id").agg(F.min("v").alias("v"))
    base, asked = as_vectors(rows), checkpointed(as_vectors(queries))
    # equal vectors once, named by their smallest id; k + 1 ids suffice, as a query leaves out its own
    listed = _top(base, k + 1, "v", F.col("id")).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = checkpointed(listed.select(F.get("ids", F.lit(0)).alias("row"), "ids", "v"))
    n = entries.count()
    names = asked.groupBy("v").agg(F.min("id").alias("query"))
    if not n or asked.isEmpty():
        return spark.createDataFrame([], out)
    share = min(1.0, sample_rows / n)
    sample = entries if share == 1.0 else entries.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)))
    vectors = np.array([r["v"] for r in sample.select("v").toLocalIterator()], np.float64)
    pairs = _candidates(entries, names, fit_codes(vectors, k=k), n, group_rows)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosines(_matrix(b.column(2)), _matrix(b.column(3))))], ["query", "row", "score"])

    with_vectors = pairs.join(entries.select("row", "v"), "row").join(names.withColumnRenamed("v", "w"), "query").select("query", "row", "v", "w")
    best = _top(with_vectors.mapInArrow(rerank, "query bigint, row bigint, score double"), k + 1, "query", F.desc("score"), F.col("row"))
    # back from vectors to ids, on both sides
    each = asked.join(names, "v").select(F.col("id").alias("query_id"), "query")
    listed = best.join(entries.select("row", "ids"), "row").join(each, "query").select("query_id", F.explode("ids").alias("id"), "score").where("id <> query_id")
    found = checkpointed(_top(listed, k, "query_id", F.desc("score"), F.col("id")))
    short = asked.join(found.where(F.col("rank") == k), asked["id"] == found["query_id"], "left_anti")
    exact = _from_all(base, short, k)
    if exact is not None:
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "id", "score").union(exact)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _candidates(entries: DataFrame, names: DataFrame, model: Codes, n: int, group_rows: int) -> DataFrame:
    """(query, row) that probing finds within the radius, each once: pairs of near copies meet in nearly all substrings."""
    spark = entries.sparkSession
    codes = spark.sparkContext.broadcast(model)
    lead = min(12, max(0, -(-n // group_rows) - 1).bit_length())
    low = SUBSTRING_BITS - lead
    entry = "part int, prefix int, value int, id bigint, code binary"

    def indexed(batches: Iterator[pa.RecordBatch], reached: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        tables = codes.value.tables
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                packed = codes.value.encode(_matrix(some.column(1)))
                whole = pa.array([c.tobytes() for c in packed], pa.binary())
                for j in range(tables):
                    value = packed[:, j].astype(np.int32)
                    prefix = value >> low
                    places = np.arange(len(value)) if reached is None else np.repeat(np.arange(len(value)), len(reached))
                    if reached is not None:
                        prefix = (prefix[:, None] ^ reached).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), j, np.int32)), pa.array(prefix.astype(np.int32)), pa.array(value[places]), some.column(0).take(pa.array(places)), whole.take(pa.array(places))], ["part", "prefix", "value", "id", "code"])

    reached = masks(lead, model.reach).astype(np.int32)
    index = entries.select("row", "v").mapInArrow(lambda b: indexed(b, None), entry)
    probes = names.select("query", "v").mapInArrow(lambda b: indexed(b, reached), entry)
    # groups far above the aim are split; every part is asked
    # (at most SUBSTRINGS << 12 of them: small enough to broadcast, so that the index is shuffled once)
    sizes = F.broadcast(index.groupBy("part", "prefix").agg(F.ceil(F.count("*") / F.lit(4 * group_rows)).cast("int").alias("splits")))
    kept = ("part", "prefix", "value", "id", "code")
    split_index = index.join(sizes, ["part", "prefix"]).select(*kept, F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("split"))
    split_probes = probes.join(sizes, ["part", "prefix"]).select(*kept, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            as_codes = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(len(t), -1)
            value = left.column("value").to_numpy().astype(np.uint16)
            order = np.argsort(value, kind="stable")
            ids, qids = left.column("id").to_numpy()[order], right.column("id").to_numpy()
            have, asked, part = as_codes(left)[order], as_codes(right), left.column("part")[0].as_py()
            near = probe(value[order], have, right.column("value").to_numpy().astype(np.uint16), asked, left.column("prefix")[0].as_py(), lead, codes.value.reach, codes.value.radius)
            for q, r in near:
                new = first_found(have[r], asked[q], part, codes.value.reach)
                queries.append(qids[q[new]])
                found.append(ids[r[new]])
        return pa.table({"query": pa.array(np.concatenate(queries), pa.int64()), "row": pa.array(np.concatenate(found), pa.int64())})

    key = ("part", "prefix", "split")
    return split_index.groupBy(*key).cogroup(split_probes.groupBy(*key)).applyInArrow(answer, "query bigint, row bigint")


def _from_all(base: DataFrame, short: DataFrame, k: int, block: int = 4096) -> DataFrame | None:
    """The k nearest of all rows for the queries ``short`` (id, v), in blocks; None if there are none."""
    parts, waiting = [], []

    def scan() -> None:
        ids, q = np.array([i for i, _ in waiting]), np.array([v for _, v in waiting])
        shared = base.sparkSession.sparkContext.broadcast((ids, q))
        waiting.clear()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vectors = shared.value
            for b in batches:
                own, x = b.column(0).to_numpy(), _matrix(b.column(1))
                for qid, v in zip(qids.tolist(), vectors, strict=True):
                    score, keep = cosines(x, v), np.flatnonzero(own != qid)
                    best = keep[np.lexsort((own[keep], -score[keep]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qid, np.int64)), pa.array(own[best]), pa.array(score[best])], ["query_id", "id", "score"])

        parts.append(_top(base.select("id", "v").mapInArrow(search, "query_id bigint, id bigint, score double"), k, "query_id", F.desc("score"), F.col("id")))

    for r in short.toLocalIterator():
        waiting.append((r["id"], r["v"]))
        if len(waiting) == block:
            scan()
    if waiting:
        scan()
    return reduce(DataFrame.union, parts).select("query_id", "rank", "id", "score") if parts else None


def op3(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
