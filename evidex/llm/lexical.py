"""Ranked lexical search over document-sharded postings in compressed sparse rows.

Documents stay where they lie: each task cuts its documents into shards of bounded size, and a
shard holds its own terms (sorted), where each term's postings begin, and for each posting the
document's place in the shard and an integer impact, all that a term's occurrences there can
add to a score but the term's weight.  Impacts need the corpus' counts of documents and terms,
which a first pass adds up; the index is then written once as Parquet.  A search looks up how
many documents hold each of its terms, turns that into integer weights, and scores shard by
shard: term at a time into one dense accumulator of whole numbers, of which argpartition takes
the best, with all that tie with the last of them, so that the smaller id wins.  The best of
shards are merged in two steps, by groups of partitions first.

Scores are whole numbers throughout but for the logarithm in a weight, so they don't depend on
the order of rows, partitions or terms.

Cases: a null text has no terms; documents and items without terms find nothing and are not
found (the former count nowhere); repeated rows are documents of their own, as are rows of one id;
a document without an id ranks after all others of its score; each item row is ranked, also if
its id is null or repeats; very long texts are a shard of their own; empty tables give an empty
result; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import HUGE_ROWS, bounded_batches, stored, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A shard is cut once it has so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 8192, 4 << 20
#: Items searched for at once, and terms that they may have together.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 18
#: Groups of partitions whose best are merged first.
GROUPS = 64
SHARDS = "ids array<bigint>, terms binary, ends array<int>, starts array<int>, places binary, impacts binary"

#: Of each byte: 0 between terms, else the byte of a term, lower-cased.  Bytes of other letters than ASCII's belong to terms.
_BYTES = np.zeros(256, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _BYTES[_a:_b] = range(_a, _b)
_BYTES[65:91] = range(97, 123)


def terms_of(text: str | None) -> list[str]:
    """Terms of one text, in order."""
    return TERM.findall((text or "").translate(str.maketrans(_UPPER, _LOWER)))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts as one binary array, and the number of each text's."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.fill_null("").cast(pa.binary())), pa.scalar(b"\n", pa.binary()))
    raw = _BYTES[np.frombuffer(joined[0].as_buffer(), np.uint8)]
    inside = np.concatenate(([False], raw != 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 0])])
    lengths = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    last = np.cumsum(lengths + 1)
    return words, np.diff(np.searchsorted(begin, last), prepend=0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of one shard each: documents next to each other, within the stated size unless it is one text."""
    ids, texts, n, size = [], [], 0, 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(1).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            total = size + np.cumsum(lengths[at:])
            take = min(int(np.searchsorted(total, SHARD_BYTES, "right")), SHARD_DOCS - n)
            if take == 0 and n == 0:
                take = 1
            part = b.slice(at, take)
            if part.num_rows:
                ids.append(part.column(0))
                texts.append(part.column(1))
                n, size, at = n + part.num_rows, size + int(lengths[at : at + take].sum()), at + part.num_rows
            if at < b.num_rows:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, n, size = [], [], 0, 0
    if n:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``n`` terms add, for a weight of one: shorter documents than usual get more."""
    m = 100 - 50 + (50 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Index:
    """``shards`` as stored, with the corpus' number of documents that have terms and of all terms."""

    def __init__(self, shards: DataFrame, docs: int, terms: int):
        self.shards, self.docs, self.terms = shards, docs, terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, written to the shared folder."""
    rows = bounded_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for _, texts in _pieces(batches):
            sizes = tokens(texts)[1]
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    counted = rows.mapInArrow(count, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    n_docs, n_terms = counted[0] or 0, counted[1] or 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            words, sizes = tokens(texts)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            new = np.empty(len(order), np.int64)
            new[order.to_numpy()] = np.arange(len(order))
            key = new[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), sizes)
            pairs, tf = np.unique(key, return_counts=True)
            term, place = np.divmod(pairs, len(ids))
            dictionary = coded.dictionary.take(order)
            ends = np.cumsum(pc.binary_length(dictionary).to_numpy())
            starts = np.searchsorted(term, np.arange(len(dictionary) + 1))
            impact = impacts(tf, sizes[place], n_docs, n_terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(dictionary.to_pylist())], pa.binary()), pa.array([ends.astype(np.int32)]), pa.array([starts.astype(np.int32)]),
                    pa.array([place.astype(np.int32).tobytes()], pa.binary()), pa.array([impact.astype(np.int32).tobytes()], pa.binary()),
                ],
                names=[c.split()[0] for c in SHARDS.split(", ")],
            )

    return Index(stored(rows.mapInArrow(shards, SHARDS), **HUGE_ROWS), n_docs, n_terms)


class Shard:
    """One row of the index, its arrays read in place."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        ids, terms, ends, starts, places, values = (batch.column(k)[row] for k in range(6))
        self.ids = ids.values
        ends = np.concatenate(([0], ends.values.to_numpy())).astype(np.int32)
        self.terms = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), terms.as_buffer()])
        self.starts = starts.values.to_numpy()
        self.places, self.impacts = np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(values.as_buffer(), np.int32)

    def where(self, wanted: pa.Array) -> np.ndarray:
        """Number in the shard of each wanted term, -1 for those it lacks."""
        return pc.fill_null(pc.index_in(wanted, value_set=self.terms), -1).to_numpy(zero_copy_only=False)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for row in range(b.num_rows):
            yield Shard(b, row)


def holders(index: Index, terms: list[str]) -> dict[str, int]:
    """In how many documents each of the terms occurs."""
    wanted = index.shards.sparkSession.sparkContext.broadcast(pa.array([t.encode() for t in terms], pa.binary()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for shard in _shards(batches):
            at = shard.where(wanted.value)
            total += np.where(at < 0, 0, shard.starts[at + 1] - shard.starts[at])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    found = index.shards.mapInArrow(look, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {terms[r["k"]]: r["n"] for r in found}


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, highest first, ties by smaller id; whatever ties with the last is weighed before it is cut."""
    some = np.flatnonzero(score)
    if len(some) > k:
        last = score[some[np.argpartition(-score[some], k - 1)[:k]]].min()
        some = some[score[some] >= last]
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards; no task gets more than the best of a group of partitions."""
    order = (F.desc("score"), F.col("doc").asc_nulls_last(), F.col("shard"), F.col("place"))
    for by in (("q", "part"), ("q",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    return found


def _block(index: Index, asked: list[list[str]], k: int) -> DataFrame:
    """(q, rank, doc, score) of a block of queries, q being the place in the list."""
    terms = sorted({t for ts in asked for t in ts})
    df = holders(index, terms)
    known = [t for t in terms if t in df]
    number = {t: i for i, t in enumerate(known)}
    weights = np.array([weight(df[t], index.docs) for t in known], np.int64)
    lists = [[number[t] for t in dict.fromkeys(ts) if t in number] for ts in asked]
    shared = index.shards.sparkSession.sparkContext.broadcast((pa.array([t.encode() for t in known], pa.binary()), weights, lists))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, lists = shared.value
        for number, shard in enumerate(_shards(batches)):
            at = shard.where(wanted)
            ids = shard.ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            qs, places, scores = [], [], []
            for q, numbers in enumerate(lists):
                score = np.zeros(len(ids), np.int64)
                for t in numbers:
                    if at[t] >= 0:
                        some = slice(shard.starts[at[t]], shard.starts[at[t] + 1])
                        score[shard.places[some]] += weights[t] * shard.impacts[some]
                top = best(score, ids, k)
                qs.append(np.full(len(top), q, np.int32))
                places.append(top)
                scores.append(score[top])
            place = np.concatenate(places)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), shard.ids.take(pa.array(place)), pa.array(np.concatenate(scores)), pa.array(place.astype(np.int32)), pa.array(np.full(len(place), number, np.int32))], names=["q", "doc", "score", "place", "shard"])

    if not known:
        return index.shards.sparkSession.createDataFrame([], "q int, rank int, doc bigint, score bigint")
    found = index.shards.mapInArrow(search, "q int, doc bigint, score bigint, place int, shard int").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    return _merged(found, k).select("q", "rank", "doc", "score")


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 50) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item; items are a stated query set, asked in blocks."""
    spark, parts, ids, asked, size = index.shards.sparkSession, [], [], [], 0
    kind = dict(items.dtypes)[item_col]

    def ask() -> None:
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, item {kind}")
        parts.append(names.join(_block(index, asked, k), "q").select(F.col("item").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score"))

    for r in items.select(item_col, F.col(text_col).cast("string").alias("t")).toLocalIterator():
        terms = list(dict.fromkeys(terms_of(r["t"])))
        if not terms or not index.docs:
            continue
        if len(ids) == BLOCK_ITEMS or ids and size + len(terms) > BLOCK_TERMS:
            ask()
            ids, asked, size = [], [], 0
        ids.append(r[item_col])
        asked.append(terms)
        size += len(terms)
    if ids:
        ask()
    if not parts:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.union, parts)


def op11(spark, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def _tokens_sql(relation: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM {relation}"


OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, * FROM ({_tokens_sql('documents', 'doc_id')})), b AS (SELECT row_number() OVER () AS q, * FROM ({_tokens_sql('benchmark', 'item_id')})),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, CAST(len(t) AS BIGINT) AS size, unnest(t) AS term FROM d), tf AS (SELECT row, doc_id, size, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df CROSS JOIN s),
q AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM b),
sc AS (SELECT q, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * size * n) // l))))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, row) AS INT) AS rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= 50"""
