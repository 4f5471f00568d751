"""Near-duplicate reports by identifier, or by first author and title."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.lineage import cut


#: Characters of a band of places in a title.
BAND = 16


def surname(author: Column) -> Column:
    """Before the comma, else the last word."""
    return F.lower(F.when(F.contains(author, F.lit(",")), F.trim(F.substring_index(author, ",", 1))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1)))


def token_sort(title: Column) -> Column:
    words = F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths, bit-parallel (Hyyro 2004)."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / (len(a) + len(b))


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are dealt out on both sides: what grows with the reports isn't sent through the driver, however small it seems."""
    return df.hint("merge")


def title_classes(reports: DataFrame) -> DataFrame:
    """(s, t, c): the distinct pairs of first author and sorted title; c is the least id that bears it.

    A missing author or title counts as the empty one.
    """
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    named = reports.select("id", surname(empty("author")).alias("s"), token_sort(empty("title")).alias("t"))
    return named.groupBy("s", "t").agg(F.min("id").alias("c"))


def similar_titles(classes: DataFrame, least: float = 95.0) -> DataFrame:
    """(a, b), a < b: classes of one first author whose titles are alike to ``least`` per cent, all of them.

    Alike titles of lengths m <= l differ by at most d = 2 l (1 - least / 100) insertions and
    deletions.  Cut into d + 1 segments, the longer title has one that no change touches, and the
    shorter one holds it too, at most d places away: titles meet by equality on author and segment.
    """
    if not 50 < least <= 100:
        raise ValueError("least must be above 50 and at most 100")
    off = (100.0 - least) / 100.0
    changes = lambda n: F.floor(2 * n * off + 1e-9).cast("int")
    size = lambda n: F.floor(n / (changes(n) + 1)).cast("int")
    sized = classes.select("s", "t", "c", F.length("t").alias("n"))
    segments = sized.where(changes(F.col("n")) > 0).withColumn("g", size(F.col("n")))
    cut = F.transform(F.sequence(F.lit(0), changes(F.col("n"))), lambda i: F.struct((i * F.col("g")).alias("at"), F.substring(F.col("t"), i * F.col("g") + 1, F.col("g")).alias("part")))
    longer = segments.select("s", F.col("c").alias("x"), F.col("n").alias("l"), F.explode(cut).alias("k")).select("s", "x", "l", "k.*")
    # a title meets titles of its own length and above, up to the length at which it can still be alike
    reach = F.floor(F.col("n") * (1 + off) / (1 - off) + 1e-9).cast("int")
    sizes = F.array_distinct(F.transform(F.sequence(F.col("n"), reach), size))
    probes = sized.where("n > 0").select("s", F.col("c").alias("y"), F.col("n").alias("m"), "t", F.explode(sizes).alias("g")).where("g <= m")
    every = F.transform(F.sequence(F.lit(0), F.col("m") - F.col("g")), lambda i: F.struct(i.alias("from"), F.substring(F.col("t"), i + 1, F.col("g")).alias("part")))
    # bands of places are part of the key, so that what many titles of an author share meets only where it stands alike
    band = lambda at: F.floor(at / BAND).cast("int")
    far = changes(F.floor(F.col("m") * (1 + off) / (1 - off) + 1e-9))
    bands = F.sequence(band(F.greatest(F.col("from") - far, F.lit(0))), band(F.col("from") + far))
    shorter = probes.select("s", "y", "m", F.explode(every).alias("k")).select("s", "y", "m", "k.*").withColumn("band", F.explode(bands))
    longer = longer.withColumn("band", band(F.col("at")))
    near = (F.col("m") <= F.col("l")) & (F.col("x") != F.col("y")) & (F.col("l") - F.col("m") <= off * (F.col("l") + F.col("m")) + 1e-9) & (F.abs(F.col("at") - F.col("from")) <= changes(F.col("l")))
    met = longer.join(unsent(shorter), ["s", "part", "band"]).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    titles = lambda c, t: unsent(classes.select(F.col("c").alias(c), F.col("t").alias(t)))
    named = met.join(titles("a", "ta"), "a").join(titles("b", "tb"), "b").select("a", "b", "ta", "tb")

    def alike(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = [indel_ratio(x, y) >= least for x, y in zip(part["ta"], part["tb"], strict=True)]
            yield part.loc[keep, ["a", "b"]]

    return named.mapInPandas(alike, "a long, b long")


def same_identifier(reports: DataFrame) -> DataFrame:
    """(id, other): each report with the first of the same non-null identifier."""
    first = reports.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("id").alias("other"))
    return reports.join(first, "doi").where("id <> other").select("id", "other")


def mark(reports: DataFrame, least: float = 95.0, order: Sequence[Column] = ()) -> DataFrame:
    """(id, duplicate_of): greedy by ``order``, then id: a report is a duplicate of the first kept report it is like.

    For the fullest report of each kind to stay, order by what should come first, ascending:
    ``order=[~F.col("full_text"), -F.col("word_count")]``.

    Reports are alike by identifier, by an equal title or by similar titles of one first author;
    titles are compared once per class of equal ones.  Of reports with one class and identifier, or
    none, only the first can be kept, as all are like the same reports: only it takes part in rounds.
    Each round keeps every open report that is
    before all open reports it is like, and settles those like it.  At least the first open report
    is settled in a round, and rounds end when none is open; ids are taken to be unique.
    """
    classes = cut(title_classes(reports))
    similar = cut(similar_titles(classes, least))
    near = similar.select(F.col("a").alias("c"), F.col("b").alias("n")).union(similar.select("b", "a"))
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("id").alias("id")).alias("id")
    rows = cut(reports.select(place, "doi", surname(empty("author")).alias("s"), token_sort(empty("title")).alias("t")).join(unsent(classes), ["s", "t"]).select("id", "c", "doi"))
    still = cut(rows.groupBy("c", "doi").agg(F.min("id").alias("id")).select("id", "c", "doi"))
    kept, step = still.limit(0), 0
    while not still.isEmpty():
        step += 1
        first = still.groupBy("c").agg(F.min("id").alias("id"))
        around = near.join(unsent(first.select(F.col("c").alias("n"), F.col("id").alias("g"))), "n").groupBy("c").agg(F.min("g").alias("g"))
        by_doi = still.where("doi is not null").groupBy("doi").agg(F.min("id").alias("h"))
        new = cut(still.join(unsent(first), ["c", "id"]).join(unsent(around), "c", "left").where("g is null or id < g").join(unsent(by_doi), "doi", "left").where("h is null or id = h").select("id", "c", "doi"))
        if new.isEmpty():
            raise RuntimeError("no open report could be settled")
        gone = new.select("c").union(near.join(unsent(new), "c").select("n")).distinct()
        still = cut(still.join(unsent(gone), "c", "left_anti").join(unsent(new.where("doi is not null").select("doi").distinct()), "doi", "left_anti").select("id", "c", "doi"))
        kept = kept.unionByName(new)
        if step % 10 == 0:
            kept = cut(kept)
    kept = cut(kept)
    by_title = kept.select("c", "id").union(near.join(unsent(kept), "c").select("n", "id")).groupBy("c").agg(F.min("id").alias("x"))
    by_doi = kept.where("doi is not null").groupBy("doi").agg(F.min("id").alias("y"))
    told = rows.join(unsent(by_title), "c", "left").join(unsent(by_doi), "doi", "left").withColumn("to", F.least("x", "y"))
    return told.select("id.id", F.when(F.col("to") != F.col("id"), F.col("to.id")).alias("duplicate_of"))
