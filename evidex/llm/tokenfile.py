"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a selector in its upper four bits and, below, as many ids
as fit at one width.  Blocks of a fixed number of ids start at known words, so
readers decode any block alone, with whole-array operations: selectors give
counts, counts give positions, shifts and masks give ids.  A value that is too
wide for any width is escaped: its word says where in the block's list of wide
values it stands.

Files: one row per run of documents, in Parquet, in ascending order of id over
all files (range-partitioned and sorted).  A row holds the first position of
its ids in the whole corpus, its documents' ids and lengths, the words, and the
word offset of each block.

Cases: null and empty texts have the end id alone; repeated rows are written
each; rows without an id come first; very long texts span many blocks of one
row; an empty table writes an empty data set; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.llm.common import bounded_batches, ensure_checkpoint_dir, table
from evidex.llm.pieces import in_runs, pieces

#: Selector s packs COUNT[s] ids of WIDTH[s] bits; the last selector is the escape.
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1], np.int64)
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60], np.uint64)
ESCAPE = 15
BLOCK = 4096
#: The first selector that holds an id, for ids below 65536.
_NEED = (np.arange(1 << 16, dtype=np.uint64)[:, None] >> WIDTH[:14] != 0).sum(axis=1).astype(np.uint8)
#: How windows are put together: size, sizes of the first and second part (which may overlap).
_PARTS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, wide values) of unsigned ids.

    All blocks advance together, one word each per step.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    wide_at = np.flatnonzero(ids >> np.uint64(60))
    wide = ids[wide_at]
    blocks = -(-n // block)
    ends = np.minimum(np.arange(1, blocks + 1) * block, n)
    # the first selector whose width each id fits; blocks are rows, with room for windows past their ends:
    # a word may end short only there
    need = _NEED[np.minimum(ids, np.uint64(len(_NEED) - 1)).astype(np.int64)]
    large = np.flatnonzero(ids >= len(_NEED))
    need[large] = (ids[large, None] >> WIDTH[:14] != 0).sum(axis=1)
    rows = np.zeros((blocks, block + 60), np.uint8)
    padded = np.zeros(blocks * block, np.uint8)
    padded[:n] = need
    rows[:, :block] = padded.reshape(blocks, block)
    most = {1: rows}  # the greatest need in a window, from those of its parts
    for count, (left, right) in _PARTS.items():
        most[count] = most[left].copy()
        most[count][:, :-left] = np.maximum(most[left][:, :-left], most[right][:, left:])
    choice = np.full((blocks, block), ESCAPE, np.uint8)
    for s in range(13, -1, -1):
        np.copyto(choice, np.uint8(s), where=most[int(COUNT[s])][:, :block] <= s)
    selector = choice.reshape(-1)[:n].astype(np.int64)
    at = ends - np.diff(np.concatenate(([0], ends)))
    live, starts = np.arange(blocks), np.zeros(n, bool)
    step = COUNT[selector]
    while len(live):
        here = at[live]
        starts[here] = True
        here += step[here]
        at[live] = here
        live = live[here < ends[live]]
    begin = np.flatnonzero(starts)
    sel = selector[begin]
    taken = np.diff(np.append(begin, n))
    shift = ((np.arange(n) - np.repeat(begin, taken)) * np.repeat(WIDTH[sel].astype(np.int64), taken)).astype(np.uint64)
    value = ids.copy()
    value[wide_at] = np.arange(len(wide), dtype=np.uint64)
    words = np.bitwise_or.reduceat(value << shift, begin)
    words |= sel.astype(np.uint64) << np.uint64(60)
    return words, np.concatenate((np.searchsorted(begin, np.arange(blocks) * block), [len(words)])), wide


def decode(words: np.ndarray, total: int, offsets: np.ndarray, wide: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of :func:`encode`; ``offsets`` say which words belong to which block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    taken = COUNT[sel].copy()
    # the last word of each block may be short
    blocks = len(offsets) - 1
    if blocks:
        sizes = np.minimum(block, total - np.arange(blocks) * block)
        sums = np.add.reduceat(taken, offsets[:-1])
        taken[offsets[1:] - 1] -= sums - sizes
    slot = np.arange(int(taken.sum())) - np.repeat(np.cumsum(taken) - taken, taken)
    width = WIDTH[sel]
    ids = (np.repeat(words, taken) >> (slot.astype(np.uint64) * np.repeat(width, taken))) & np.repeat((np.uint64(1) << width) - np.uint64(1), taken)
    if len(wide):
        escaped = np.repeat(sel == ESCAPE, taken)
        ids[escaped] = wide[ids[escaped].astype(np.int64)]
    return ids


ROW = "part int, seq bigint, docs array<bigint>, lengths array<bigint>, words binary, block_words array<bigint>, wide binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts to ``path``, in ascending order of id over its files."""
    picked = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = pieces(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, run in in_runs(batch.column(1).to_pylist()):
                ids, begin = own.encode(run)
                ids = np.insert(ids, begin[1:], end_id)  # the end id after each document
                lengths = np.diff(begin) + 1
                words, offsets, wide = encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([keys[at : at + len(run)]], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([wide.astype("<u8").tobytes()], pa.binary())],
                    ["part", "seq", "docs", "lengths", "words", "block_words", "wide"],
                )
                seq += 1

    # the row's place in the input breaks ties, so that a repeated id can be split between ranges
    tie = F.monotonically_increasing_id()
    ordered = picked.withColumn("tie", tie).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(packed, ROW).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, decoded from the files."""
    stored = spark.read.parquet(path)
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sizes = stored.select("part", "seq", total.alias("n"))
    # positions: sums within each file's partition, then over the partitions (one row each)
    by_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    bases, base = [], 0
    for r in by_part.orderBy("part").toLocalIterator():
        bases.append((r["part"], base))
        base += r["n"]
    first = spark.createDataFrame(bases, "part int, base bigint")
    within = sizes.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("before"))
    starts = within.join(first, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, lengths, words, offsets, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode(np.frombuffer(words, "<u8"), sum(lengths), np.array(offsets, np.int64), np.frombuffer(wide, "<u8")).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths, pa.int64()), pa.array([ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths, strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return stored.join(starts, ["part", "seq"]).select("start", "docs", "lengths", "words", "block_words", "wide").mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
