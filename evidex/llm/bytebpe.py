"""Byte-level BPE by Spark's higher-order functions over distinct words.

A word is a sequence of symbols, one per token so far: a string whose characters stand
for ids, at first those of its bytes.  ``aggregate`` folds the ranked merges over it: in
ascending rank, the pair that the literal rank map names is replaced by its token.  Only
merges whose token occurs in the word's bytes can apply, so these alone are folded.

One pass in ascending rank is exact where every token is what its own bytes merge to
(checked when the ranks are read): what lies between two borders of a word then always
merges as it would alone, so no merge can make a pair of a lower rank possible.  A token
without that property is never met in practice; words that hold its bytes, and words of
more than ``LONG`` bytes, for which a fold would be quadratic, merge by a priority queue.

Each task folds each distinct word once: a first step cuts documents into words, numbers
them and sends only words new to the task along with a document; Spark folds these; a
second step keeps their ids by number and puts the documents' ids together.  No text is
shuffled and nothing is collected.  At ``limit`` words both steps begin their tables anew.

Cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded
each; texts of any length are read whole; an empty table gives an empty result; other
columns are not read; lone surrogates can't occur in Spark's strings.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import bounded_batches, table

LONG = 1024
#: Words folded together, each merge tried once for all of them.
TOGETHER = 4
#: Between words, and before a word that is not to be folded.
BORDER, WHOLE = chr(0x10FFFF), chr(0x10FFFE)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def symbol(rank: int) -> str:
    """The character that stands for an id; surrogates are left out."""
    return chr(rank if rank < 0xD800 else rank + 0x800)


def halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the bytes of a token merge to by lower ranks alone: two parts, if the token is their merge."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Merges:
    """Of each rank its pair, as symbols; ``odd`` ranks have none."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes")
        self.pairs = [""] * (max(ranks.values()) + 1)
        self.odd: set[int] = set()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = halves(token, ranks)
                if len(parts) == 2:
                    self.pairs[rank] = symbol(ranks[parts[0]]) + symbol(ranks[parts[1]])
                else:
                    self.odd.add(rank)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once and written once into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_all(words: Column, merges: Merges) -> Column:
    """Of array<struct<symbols string, merges array<int>>>: the symbols left after the merges, which ascend."""
    literal = lambda x: F.from_json(F.lit(json.dumps(x)), "array<string>")
    pairs, tokens = literal(merges.pairs), literal([symbol(i) for i in range(len(merges.pairs))])
    return bound(
        pairs,
        lambda p: bound(
            tokens,
            lambda t: F.transform(words, lambda w: F.aggregate(w["merges"], w["symbols"], lambda s, rank: F.replace(s, F.get(p, rank), F.get(t, rank)))),
        ),
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a priority queue, for very long words."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(queue)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            r = ranks.get(word[i : end[end[i]]])
            if r is not None:
                heapq.heappush(queue, (r, i, end[end[i]]))

    while queue:
        _, i, stop = heapq.heappop(queue)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Numbers(dict):
    """Numbers for words in the order in which they are met; ``new`` lists those not yet sent on."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Cutter:
    """Cuts texts into numbered words, and finds the merges that may apply to new ones."""

    def __init__(self, ranks: dict[bytes, int], odd: set[int], pattern: str, limit: int):
        import ahocorasick

        self.find, self.limit, self.odd = regex.compile(pattern).findall, limit, odd
        self.bytes = {b: symbol(ranks[bytes([b])]) for b in range(256)}
        self.tokens = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.tokens.add_word(token.decode("latin-1"), rank)
        self.tokens.make_automaton()
        self.numbers = Numbers()

    def cut(self, text: str) -> tuple[bool, bytes, list[tuple[str, list[int]]]]:
        """(tables begin anew, word numbers, new words as symbols with their merges)."""
        fresh = len(self.numbers) > self.limit
        if fresh:
            self.numbers = Numbers()
        numbers = self.numbers
        codes = array("I", map(numbers.__getitem__, self.find(text))).tobytes()
        out, new = [], numbers.new
        if new:
            numbers.new = []
            names, merges = [], set()
            for w in new:
                raw = w.encode("utf-8", "surrogatepass").decode("latin-1")
                found = {rank for _, rank in self.tokens.iter(raw)} if len(raw) <= LONG else None
                if found is None or not self.odd.isdisjoint(found):
                    if names:
                        out.append((BORDER.join(names), sorted(merges)))
                    out.append((WHOLE + raw.translate(self.bytes), []))
                    names, merges = [], set()
                    continue
                names.append(raw.translate(self.bytes))
                merges |= found
                if len(names) == TOGETHER:
                    out.append((BORDER.join(names), sorted(merges)))
                    names, merges = [], set()
            if names:
                out.append((BORDER.join(names), sorted(merges)))
        return fresh, codes, out


class Known:
    """The ids of words by number."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_id = {symbol(ranks[bytes([b])]): b for b in range(256)}
        self.clear()

    def clear(self) -> None:
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, folded: list[str]) -> None:
        if not folded:
            return
        text = BORDER.join(folded)
        if WHOLE in text:
            text = BORDER.join("".join(map(symbol, self._merged(w[1:]))) if w.startswith(WHOLE) else w for w in text.split(BORDER))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.append(np.flatnonzero(codes == ord(BORDER)), len(codes))
        lengths = np.diff(ends, prepend=-1) - 1
        ids = codes[codes != ord(BORDER)]
        ids = ids - np.uint32(0x800) * (ids >= 0xE000).astype(np.uint32)
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.used + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.start[self.used : self.used + len(lengths)] = self.filled + np.cumsum(lengths) - lengths
        self.length[self.used : self.used + len(lengths)] = lengths
        self.used, self.filled = self.used + len(lengths), self.filled + len(ids)

    def _merged(self, symbols: str) -> list[int]:
        return merge_long(bytes(map(self.of_id.__getitem__, symbols)), self.ranks)

    def gather(self, numbers: list[bytes]) -> list[bytes]:
        """The ids of documents, as bytes, from their words' numbers."""
        codes = np.frombuffer(b"".join(numbers), "<u4")
        length = self.length[codes]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.start[codes] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers)) // 4)))] * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 400_000) -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers."""
    # several workers a task hold batches, with ids of many times a text's size
    picked = bounded_batches(docs, 256).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    merges = Merges(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merges.odd))
    kind = picked.schema["id"]
    word = pa.struct([("symbols", pa.string()), ("merges", pa.list_(pa.int32()))])
    cut_up = T.StructType([kind, T.StructField("fresh", T.BooleanType()), T.StructField("numbers", T.BinaryType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("symbols", T.StringType()), T.StructField("merges", T.ArrayType(T.IntegerType()))])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(*shared.value, pattern, limit)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # small batches: new words take more room than their text
                part = batch.slice(at, 64)
                fresh, numbers, words = zip(*(cutter.cut(t or "") for t in part.column(1).to_pylist()), strict=True)
                found = [{"symbols": s, "merges": m} for ws in words for s, m in ws]
                ends = np.concatenate(([0], np.cumsum([len(ws) for ws in words]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fresh), pa.array(numbers, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found, word))], ["id", "fresh", "numbers", "words"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value[0])
        for batch in batches:
            fresh, numbers = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False)), batch.column(2).to_pylist()
            bounds = sorted({0, *fresh.tolist(), batch.num_rows})
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a in fresh:
                    known.clear()
                known.add(batch.column(3).slice(a, b - a).flatten().to_pylist())
                out += known.gather(numbers[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "ids"])

    folded = picked.mapInArrow(cut, cut_up).select("id", "fresh", "numbers", fold_all(F.col("words"), merges).alias("words"))
    return folded.mapInArrow(put_together, T.StructType([kind, T.StructField("ids", T.BinaryType())])).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """(id, ids, bytes): the joined binary pieces of the ids."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            ids = np.frombuffer(b"".join(blobs), "<u4")
            joined = tokens.take(pa.array(ids))  # the pieces lie one after another in its buffer
            at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)))
            _, offsets, data = joined.buffers()
            ends = np.frombuffer(offsets, np.int64)[at].tolist() if len(ids) else [0] * len(at)
            raw = data.to_pybytes() if data is not None and len(ids) else b""
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], [*batch.schema.names, "bytes"])

    picked = encoded.select(id_col, "ids")
    return picked.mapInArrow(join, T.StructType([*picked.schema.fields, T.StructField("bytes", T.BinaryType())]))


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    done = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


