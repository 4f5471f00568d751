"""SimHash near-duplicates, found through a Gray-order hierarchical index.

Fingerprints: 64 bits from the XXH64 values of word shingles, a bit set where
more than half of the shingles set it.  Two fingerprints link if they differ
in few bits; documents belong to the connected components of the links.

Index: equal fingerprints are first merged.  The 64 bits are cut into one block
more than the allowed differences, so linked fingerprints share a whole block;
for each block the fingerprints are rotated to start with it and dealt out by
their leading bits (the top node's shared bit pattern; more bits, and so more
groups, as the number of fingerprints grows).  A group is sorted by Gray rank.
Each node of the tree over that order keeps the bits that all codes below it
share, as a mask and a pattern; a pair of nodes is dropped, with everything
below, as soon as the patterns differ in too many bits that both share, or as
soon as everything below is connected already.  Groups hand on a spanning
forest of their links, never all pairs, and its components are joined across
groups by rounds of minimum labels over the edges, in Spark.

A fingerprint whose bits are plain majorities tells little of a shingle similarity of 0.8: its
bits differ in 15 % of places there, and 20 % at 0.67.  Where a similarity is asked for
(:func:`similar_groups`), shingles vote with weights instead, drawn anew for each bit and so
unequal that the heaviest decides; the places that differ then are half of what the sets of shingles
lack in similarity.  A document has several such fingerprints, indexed as above by longer
blocks; pairs that share a block meet, and the distance over the other fingerprints sorts them
into surely alike, surely not, and open.  Exact sets of shingles decide the open ones, where
surely alike pairs don't connect both sides anyway.

Cases: null, empty and blank texts have fingerprint zero and link like any
others; texts under a shingle's length are one shingle; repeated rows share a
component; a component whose documents all have null ids has a null
component_id; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import bounded_batches, checkpointed, free_prefix, stored, table

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Codes below one leaf of the tree.
LEAF = 16
#: Codes aimed at per group; groups grow beyond it only when a block's bits run out.
GROUP = 8192


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray | None:
    """XXH64 of the shingles of one whole text; None without words."""
    if not text:
        return None
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return None
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - shingle + 1
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    hashes = shingle_hashes(text, shingle)
    return 0 if hashes is None else majority(hashes)


def _draws(words: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd 32-bit factors, two for each bit of ``words`` fingerprints: one ranks shingles, one takes a bit of the first in rank."""
    drawn = np.random.default_rng(5).integers(0, 1 << 32, (2, words * BITS), np.uint32) | np.uint32(1)
    return drawn[0], drawn[1]


def sketch(text: str | None, shingle: int, words: int) -> np.ndarray:
    """``words`` fingerprints of one whole text, each bit that of the heaviest shingle; zero without words."""
    hashes = shingle_hashes(text, shingle)
    if hashes is None:
        return np.zeros(words, np.uint64)
    rank, take = _draws(words)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    first = np.full(len(rank), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):  # bounded memory for very long texts
        np.minimum(first, (x[None, at : at + 2048] * rank[:, None]).min(axis=1), out=first)
    return np.packbits((first * take) >> np.uint32(31) > 0, bitorder="little").view("<u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at : at + 65536].astype("<u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed bigint."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    picked = bounded_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(compute, f"id {picked.schema['id'].dataType.simpleString()}, fp bigint")


# --- the tree over one group of codes -------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the order of reflected Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Union-find over the positions of a group; keeps the pairs that joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def labels(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                return p
            self.parent = p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the sets of a[i] and b[i], all at once, by minimum labels."""
        while len(a):
            p = self.labels()
            x, y = p[a], p[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(self.parent, high, low)
            took = np.flatnonzero(self.parent[high] == low)
            took = took[np.unique(high[took], return_index=True)[1]]
            self.pairs.append((a[took], b[took]))


def forest_of_links(codes: np.ndarray, block_mask: np.uint64, differences: int, checks: np.ndarray | None = None, most: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, k): places of codes that are linked and share the block, a spanning forest of all such links.

    The codes are already rotated so that the block is on top; block_mask covers it.  With
    ``checks``, rows of further words, a link also needs these to differ in at most ``most[k]`` bits,
    an ascending list: links of later limits only join what earlier ones leave apart.
    """
    n = len(codes)
    order = np.argsort(gray_rank(codes), kind="stable")
    c = codes[order]
    if checks is not None:
        checks = checks[order]
    forest, limits = _Forest(n), []
    for limit in most:
        _connect(c, c & block_mask, forest, np.uint8(differences), checks, limit)
        limits.append(sum(len(p) for p, _ in forest.pairs))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[side] for p in forest.pairs)]) for side in (0, 1))
    return order[a], order[b], np.searchsorted(limits, np.arange(len(a)), "right")


def _connect(c: np.ndarray, block: np.ndarray, forest: _Forest, h: np.uint8, checks: np.ndarray | None, most: int) -> None:
    """All links among codes in Gray order that share a block."""
    n = len(c)
    for step in (1, 2, 3):  # neighbours in Gray order first: most links of a dense cluster
        if n > step:
            near = np.flatnonzero((np.bitwise_count(c[step:] ^ c[:-step]) <= h) & (block[step:] == block[:-step]))
            forest.link(*_fitting(near, near + step, checks, most))
    # leaves never straddle two blocks: each run of equal block bits has its own leaves
    begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    sizes = np.diff(np.append(begins, n))
    for size, at in zip(sizes.tolist(), begins.tolist(), strict=True):
        if size > 4 * LEAF:
            _search(c, at, size, forest, h, checks, most)
    small = sizes <= 4 * LEAF
    if small.any():
        run_end = np.repeat(begins + sizes, sizes)
        inside = np.repeat(small, sizes)
        for step in range(4, int(sizes[small].max())):
            i = np.flatnonzero(inside[:-step] & (np.arange(n - step) + step < run_end[:-step]))
            near = i[np.bitwise_count(c[i] ^ c[i + step]) <= h]
            forest.link(*_fitting(near, near + step, checks, most))


def _fitting(a: np.ndarray, b: np.ndarray, checks: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[i], b[i]) those whose further words are near enough."""
    if checks is None or not len(a):
        return a, b
    ok = np.bitwise_count(checks[a] ^ checks[b]).sum(axis=1, dtype=np.int64) <= most
    return a[ok], b[ok]


def _search(c: np.ndarray, at: int, size: int, forest: _Forest, h: np.uint8, checks: np.ndarray | None, most: int) -> None:
    """Pairs of nodes of one run's tree, from the root down, several at a time."""
    depth = max(0, int(np.ceil(np.log2(size / LEAF))))
    leaves = 1 << depth
    bounds = at + (np.arange(leaves + 1) * size) // leaves
    levels = []
    ands, ors = np.bitwise_and.reduceat(c[: at + size], bounds[:-1]), np.bitwise_or.reduceat(c[: at + size], bounds[:-1])
    for _ in range(depth + 1):
        levels.append((ands, ~(ands ^ ors)))
        if len(ands) > 1:
            ands, ors = ands[0::2] & ands[1::2], ors[0::2] | ors[1::2]
    levels.reverse()  # root first

    def uniform() -> list[np.ndarray]:
        """Per level, the label that all codes below a node share, or -1 less the node."""
        lab = forest.labels()[: at + size]
        low, high = np.minimum.reduceat(lab, bounds[:-1]), np.maximum.reduceat(lab, bounds[:-1])
        out = []
        for _ in range(depth + 1):
            out.append(np.where(low == high, low, -1 - np.arange(len(low))))
            if len(low) > 1:
                low, high = np.minimum(low[0::2], low[1::2]), np.maximum(high[0::2], high[1::2])
        return out[::-1]

    same = uniform()
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    since = 0
    while stack:
        level, a, b = stack.pop()
        pattern, mask = levels[level]
        keep = (np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= h) & ~((same[level][a] == same[level][b]) & (same[level][a] >= 0))
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if len(a) > 2048:  # depth first in pieces: bounded memory
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        if level < depth:
            own = a == b
            x, y = a[~own], b[~own]
            stack.append((level + 1, np.concatenate((2 * a[own], 2 * a[own], 2 * a[own] + 1, 2 * x, 2 * x, 2 * x + 1, 2 * x + 1)), np.concatenate((2 * a[own], 2 * a[own] + 1, 2 * a[own] + 1, 2 * y, 2 * y + 1, 2 * y, 2 * y + 1))))
            continue
        width = int((bounds[1:] - bounds[:-1]).max())
        ia = bounds[a][:, None] + np.arange(width)
        ib = bounds[b][:, None] + np.arange(width)
        fits_a, fits_b = ia < bounds[a + 1][:, None], ib < bounds[b + 1][:, None]
        ia, ib = np.minimum(ia, at + size - 1), np.minimum(ib, at + size - 1)
        near = (np.bitwise_count(c[ia][:, :, None] ^ c[ib][:, None, :]) <= h) & fits_a[:, :, None] & fits_b[:, None, :]
        p, i, j = np.nonzero(near)
        left, right = ia[p, i], ib[p, j]
        useful = left != right
        left, right = _fitting(left[useful], right[useful], checks, most)
        if len(left):
            forest.link(left, right)
            since += 1
            if since >= 8:
                same, since = uniform(), 0


# --- the joins across groups ----------------------------------------------------------


def links(distinct: DataFrame, n: int, differences: int = 4, fp_col: str = "fp") -> DataFrame:
    """Edges (a, b) of a spanning forest of the links among ``n`` distinct fingerprints."""
    blocks = differences + 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    width = min(cuts[k + 1] - cuts[k] for k in range(blocks))
    lead = min(width, max(0, (max(n, 1) // GROUP).bit_length()))
    fp = F.col(fp_col)
    #: rotated so that the block comes first
    turned = [F.shiftleft(fp, cuts[k]).bitwiseOR(F.shiftrightunsigned(fp, BITS - cuts[k])) if k else fp for k in range(blocks)]
    dealt = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.shiftrightunsigned(t, BITS - lead) if lead else F.lit(0).cast("bigint")).alias("top"), t.alias("code")) for k, t in enumerate(turned)))).alias("x")).select("x.*")
    masks = [int(((1 << (cuts[k + 1] - cuts[k])) - 1) << (BITS - (cuts[k + 1] - cuts[k]))) for k in range(blocks)]

    def forest(groups: pa.Table) -> pa.Table:
        k = groups.column("k")[0].as_py()
        codes = groups.column("code").to_numpy().view(np.uint64)
        a, b, _ = forest_of_links(codes, np.uint64(masks[k]), differences)
        turn = np.uint64(cuts[k])
        back = lambda x: (x >> turn) | (x << (np.uint64(BITS) - turn)) if k else x
        return pa.table({"a": back(codes[a]).view(np.int64), "b": back(codes[b]).view(np.int64)})

    return dealt.groupBy("k", "top").applyInArrow(forest, "a bigint, b bigint")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); each round is
    checkpointed in the shared folder, and rounds end when no edge changes.
    """
    state = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def size_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = size_of(state)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        state = checkpointed(small)
        after = size_of(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _named(lowest: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, component_id, root) from (node, low) and the roots; a large component's rows are dealt out by a salt."""
    salts = 16
    named = lowest.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)).withColumn("_s", F.pmod(F.xxhash64(node), F.lit(salts)))
    least = named.groupBy("root").agg(F.min("low").alias("component_id")).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return named.join(least, ["root", "_s"]).select(node, "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, differences: int = 4) -> DataFrame:
    """(id, fp, component_id, root) for every row of ``docs``: the smallest id and smallest fingerprint reachable."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    lowest = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("low")))
    by_fp = _named(lowest, components(links(lowest, lowest.count(), differences)), "fp")
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")


#: Fingerprints of a document where a similarity is asked for, and blocks of each by which pairs meet.
WORDS, BLOCKS = 6, 4


def most_bits(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits of sketches at a similarity, and so many standard deviations."""
    share = (1 - similarity) / 2
    return int(np.ceil(bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, digest, code): a hash of the text, and WORDS fingerprints as bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sketch(t, shingle, WORDS).astype("<u8").tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["id", "digest", "code"])

    text = docs[text_col].cast("string")
    picked = bounded_batches(docs).select(docs[id_col].alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return picked.mapInArrow(compute, T.StructType([picked.schema["id"], T.StructField("digest", T.LongType()), T.StructField("code", T.BinaryType())]))


def met(lowest: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b, sure): links among ``n`` nodes (node, code) whose sketches are alike; sure ones need no more proof.

    Two fingerprints of a pair at the similarity share none of the blocks in less than 1 % of cases at 0.8.
    """
    width = BITS // BLOCKS
    lead = min(width, max(0, (max(n, 1) // GROUP).bit_length()))
    others = (WORDS - 1) * BITS
    limits = (most_bits(similarity, others, -4.0), most_bits(similarity, others, 2.0))
    found = most_bits(similarity, BITS - width, 2.5)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
            nodes = batch.column(0).to_numpy().view(np.uint64)
            for w in range(WORDS):
                # a pair that meets by one fingerprint is checked by the others
                checks = np.delete(codes, w, axis=1)
                for k in range(BLOCKS):
                    cut = np.uint64(k * width)
                    word = (codes[:, w] << cut) | (codes[:, w] >> (np.uint64(BITS) - cut)) if k else codes[:, w]
                    top = word >> np.uint64(BITS - lead) if lead else np.zeros(len(word), np.uint64)
                    key = top.astype(np.int64) * (WORDS * BLOCKS) + (w * BLOCKS + k)
                    rows = np.column_stack((word, nodes, checks)).astype("<u8")
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([r.tobytes() for r in rows], pa.binary())], ["key", "entry"])

    def forest(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("entry").to_pylist()), "<u8").reshape(len(group), -1)
        nodes = rows[:, 1].astype(np.uint64).view(np.int64)
        a, b, k = forest_of_links(rows[:, 0].astype(np.uint64), np.uint64(((1 << width) - 1) << (BITS - width)), found, rows[:, 2:], limits)
        return pa.table({"a": nodes[a], "b": nodes[b], "sure": k == 0})

    dealt = lowest.select("node", "code").mapInArrow(deal, "key bigint, entry binary")
    pairs = dealt.groupBy("key").applyInArrow(forest, "a bigint, b bigint, sure boolean")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure"))


def alike(pairs: DataFrame, named: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of ``pairs`` (a, b) of nodes those whose sets of shingles have the similarity.

    ``named`` has a document (id, digest) for each node, ``docs`` (id, digest, text).
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"" if x is None else np.unique(x).tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= similarity * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(named.join(nodes, "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("digest").alias("_digest")))
    texts = docs.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id"))).select("node", "text")
    sets = texts.mapInArrow(collect, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, node, component_id, root) for every row: groups of texts linked at the similarity.

    Texts link if their sets of shingles have at least the similarity (of those just at 0.8 some 95 % are met), or
    if their sketches leave no doubt; texts of equal sketches are one node, named by a 64-bit digest: among
    10^9 different ones two meet with a probability of 3 %.  Digests of texts tell apart rows of one id.
    """
    marked = checkpointed(sketches(docs, id_col, text_col, shingle).withColumn("node", F.xxhash64("code")))
    lowest = checkpointed(marked.groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("id", "digest")).alias("one"), F.first("code").alias("code")))
    pairs = checkpointed(met(lowest, lowest.count(), similarity))
    near = components(pairs.where("sure"))
    # open pairs count only where sure ones leave their sides apart; those that hold join the groups of the sure ones
    side = lambda c: near.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.where("not sure").select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b")).where("root_a <> root_b")
    apart = checkpointed(apart)
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("digest"), docs[text_col].cast("string").alias("text"))
    held = alike(apart.select("a", "b"), lowest.select("node", "one.id", "one.digest"), texts, similarity, shingle)
    joined = components(held.join(apart, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    roots = near.select("node", "root").union(joined.select("node", F.col("node").alias("root"))).distinct()
    roots = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root"))
    by_node = _named(lowest.select("node", "low"), roots, "node")
    return marked.join(by_node, "node").select(F.col("id").alias(id_col), "digest", "node", "component_id", "root")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, differences: int = 4, similarity: float | None = None) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, then of the smallest digest of its text; all columns of ``docs``.

    Groups are those of :func:`near_duplicates`, or with ``similarity`` those of :func:`similar_groups`.
    Rows without an id are kept only if no row of their group has one, and then one of them.
    Rows are found again by id and digest, as one id may stand on different texts; of rows
    that repeat both one stays.
    """
    k = free_prefix(docs, "_k")
    key, digest = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i")), F.xxhash64(F.col(text_col).cast("string"))
    keyed = docs.select(key.alias("_k"), F.col(text_col).alias("_t"))
    if similarity is None:
        named = docs.select(F.struct(key.alias("k"), digest.alias("d")).alias("_k"), F.col(text_col).alias("_t"))
        groups = near_duplicates(named, "_k", "_t", shingle, differences).select("root", F.col("_k").alias("x"))
    else:
        groups = similar_groups(keyed, similarity, shingle, "_k", "_t").select("root", F.struct(F.col("_k").alias("k"), F.col("digest").alias("d")).alias("x"))
    kept = groups.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.k").alias(f"{k}_i"), F.col("x.d").alias(f"{k}_d"))
    found = docs.withColumn(f"{k}_i", key).withColumn(f"{k}_d", digest).join(kept, [f"{k}_d", f"{k}_i"], "left_semi")
    return found.dropDuplicates([f"{k}_d", f"{k}_i"]).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
