"""Packing token ids into fixed windows, online and in bounded space.

Each partition streams its documents.  Whole windows are cut from documents
that exceed one; a remainder goes to the open window that it fits best.  When
it fits none of the fixed number of open windows, the fullest is emitted and a
new one opened.  At its end a partition hands its open windows on; leftovers of
many partitions are merged by the same rule, in fewer and fewer tasks, and each
such round emits the windows that are nearly full.

Cases: null and empty texts are one end id; repeated rows are packed each;
texts of any length are cut at window ends only; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import bounded_batches, stored, table
from evidex.llm.pieces import in_runs, pieces

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open boolean"
NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"]
_ROOM = 1 << 33  # sequences per task and round


class OpenWindows:
    """At most ``limit`` open windows, found by free room."""

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.filled: dict[int, list[tuple]] = {}

    def fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, piece: tuple, length: int) -> list[tuple[int, list[tuple]]]:
        """Puts a piece into the window that it fits best; the windows emitted to make room for it."""
        out = []
        i = bisect_left(self.free, (length, -1))
        if i < len(self.free):
            room, window = self.free.pop(i)
        else:
            if len(self.free) >= self.limit:
                _, fullest = self.free.pop(0)
                out.append((fullest, self.filled.pop(fullest)))
            room, window = self.size, self.fresh()
            self.filled[window] = []
        self.filled[window].append((*piece, self.size - room))
        if room > length:
            insort(self.free, (room - length, window))
        else:
            out.append((window, self.filled.pop(window)))
        return out


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, windows: int = 256, merge: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids."""
    picked = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = pieces(tokenizer_path)
        opened = OpenWindows(size, windows, TaskContext.get().partitionId() * _ROOM)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, run in in_runs(batch.column(1).to_pylist()):
                ids, begin = own.encode(run)
                raw = ids.astype("<u4").tobytes()
                out = []
                for key, a, b in zip(keys[at : at + len(run)], begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    blob, total = raw[4 * a : 4 * b] + end, b - a + 1
                    for start in range(0, total - total % size, size):
                        out.append((key, start, size, total, opened.fresh(), 0, blob[4 * start : 4 * (start + size)], False))
                    if rest := total % size:
                        start = total - rest
                        for window, content in opened.place((key, start, rest, total, blob[4 * start :]), rest):
                            out += [(*p[:4], window, p[5], p[4], False) for p in content]
                if out:
                    yield _emit(out)
        left = [(*p[:4], window, p[5], p[4], True) for window, content in opened.filled.items() for p in content]
        if left:
            yield _emit(left)

    parts = max(1, picked.rdd.getNumPartitions())
    packed = stored(picked.mapInArrow(first_round, PIECE))
    done = packed.where("not open")
    left = packed.where("open")
    level = 1
    while True:
        parts = -(-parts // merge)
        left = _merged(left, parts, size, windows, level, last=parts == 1)
        if parts == 1:
            return done.union(left).drop("open")
        left = stored(left)
        done = done.union(left.where("not open"))
        left = left.where("open")
        level += 1


def _merged(left: DataFrame, parts: int, size: int, windows: int, level: int, last: bool) -> DataFrame:
    """Repacks leftovers in ``parts`` tasks, longest pieces first."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        opened = OpenWindows(size, windows, (1 << 62) // (1 << level) + TaskContext.get().partitionId() * _ROOM)
        for batch in batches:
            out = []
            for doc, start, length, total, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 6)), strict=True):
                for window, content in opened.place((doc, start, length, total, ids), length):
                    out += [(*p[:4], window, p[5], p[4], False) for p in content]
            if out:
                yield _emit(out)
        rest = [(*p[:4], window, p[5], p[4], not last) for window, content in opened.filled.items() for p in content]
        if rest:
            yield _emit(rest)

    # windows of one task before go to one task now; a task holds as many windows as 'merge' tasks left
    dealt = left.repartition(parts, F.pmod(F.xxhash64("sequence_id"), F.lit(parts))).sortWithinPartitions(F.desc("length"), "doc_id", "start")
    return dealt.mapInArrow(again, PIECE)


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
