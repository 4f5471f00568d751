"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Each partition of the corpus writes the postings (document, position) of the terms that the
benchmark has, in the order of terms: a shard of the index, for which no text is shuffled.  Test
items become windows of ten consecutive words.  Occurrences of a window are found from its rarest
terms on: the postings of the rarest one, less its place in the window, say where the window
might begin; these are intersected with the postings of the second rarest, moved likewise, and the
few that are left with those of all the others.  How often terms occur is counted in the index.

With ``slack``, a term may also stand up to so many words from its place: a window all of whose
terms do is a proximity match, one whose terms all stand in their places an exact match.

The same postings tell the length of each document: an empty term stands after its last word.

Cases: null texts have no words, no hits, and are still returned; items without words have no
window; repeated rows are judged each; rows of one id with different texts are told apart
by a hash of the text; ids may be null, and windows of items without an id make
hits but count for no item; a window that several items share counts for all of them;
empty tables give an empty result or documents without hits; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.llm.common import stored, table

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows or terms up to which their tables (at most 32 bytes a row beside a term) are broadcast; beyond, joins are shuffled.
SMALL = 200_000
#: Documents up to which the keys (8 bytes each) of those that still may have a match are broadcast, so that only
#: their postings move; beyond, all postings of the benchmark's terms do.
KNOWN = 2_000_000
#: Number of the empty term; the others have numbers from 0 on, given as they are stored.
END = -1
#: Words that a term may stand from its place in a proximity match.
SLACK = 2


def words(text: Column) -> Column:
    """Words of a text, only A to Z in lower case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, terms): the distinct windows of each item, as text; all words of an item that has fewer."""
    w = F.col("w")
    begins = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    cut = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size(w) > 0)
    return cut.select("item", F.explode(F.transform(begins, lambda b: F.array_join(F.slice(w, b, size), " "))).alias("terms")).distinct()


class Index:
    """Postings of the benchmark's terms, and its windows with their terms from the rarest on.

    ``postings`` has (doc, mark, term, pos), ``terms`` (win, len, off, term, r), ``items`` (win, item);
    the postings of the term :data:`END` hold the number of words of each document.
    """

    def __init__(self, postings: DataFrame, terms: DataFrame, items: DataFrame, n_windows: int):
        self.postings, self.terms, self.items, self.n_windows = postings, terms, items, n_windows


def build(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> Index:
    """Writes the postings of all documents, and the windows of all items, to the shared folder."""
    cut = windows(items, item_col, item_text, size)
    numbered = stored(cut.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("win", F.monotonically_increasing_id()))
    n_windows = numbered.count()
    placed = numbered.select("win", F.split("terms", " ").alias("w")).select("win", F.size("w").alias("len"), F.posexplode("w").alias("off", "word"))
    vocabulary = placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    vocabulary = stored(vocabulary.union(docs.sparkSession.createDataFrame([("", END)], "word string, term bigint")))

    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("bigint")
    # digest and words first: beside posexplode they would be computed again for each word
    cut = docs.select(key.alias("doc"), F.xxhash64(text, key).alias("mark"), F.concat(words(text), F.array(F.lit(""))).alias("words"))
    positions = cut.select("doc", "mark", F.posexplode("words").alias("pos", "word"))
    postings = stored(positions.join(small(vocabulary, vocabulary.count()), "word").select("doc", "mark", "term", "pos").sortWithinPartitions("term", "doc", "pos"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("win").orderBy("n", "off")
    terms = placed.join(vocabulary, "word").join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rarest))
    return Index(postings, stored(terms.select("win", "len", "off", "term", "r")), numbered.select("win", F.explode("items").alias("item")), n_windows)


def matches(index: Index, slack: int = 0) -> DataFrame:
    """(doc, mark, win, begin, len, exact): where windows occur, all terms within ``slack`` words of their places; written to the shared folder.

    A document without an id has 0 for it here; ``mark`` tells it from others.
    """
    key = ["doc", "mark", "term", "pos"]
    postings = index.postings.withColumn("doc", F.coalesce("doc", F.lit(0))).where(F.col("term") != END)
    terms = index.terms
    n = index.n_windows
    rarest = terms.where("r = 1").select("win", "len", F.col("off").alias("off1"), "term")
    second = terms.where("r = 2").select("win", F.col("term").alias("term2"), F.col("off").alias("off2"))
    firsts = rarest.join(second, "win", "left")
    begun = postings.join(small(firsts, n), "term").select("doc", "mark", "win", "len", (F.col("pos") - F.col("off1")).alias("begin"), "term2", "off2")
    begun = begun.where(F.col("begin") >= -slack) if slack else begun.where("begin >= 0")

    def nearby(place: Column) -> Column:
        """A row for each word within the slack of a place."""
        return F.explode(F.transform(F.sequence(F.lit(-slack), F.lit(slack)), lambda d: F.struct((place + d).alias("pos"), (d == 0).alias("exact"))))

    asked = postings.join(small(second.select(F.col("term2").alias("term")).distinct(), n), "term", "left_semi")
    pairs = begun.where("term2 is not null").withColumn("at", nearby(F.col("begin") + F.col("off2"))).select("doc", "mark", "win", "len", "begin", F.col("term2").alias("term"), "at.pos", "at.exact")
    # the intersection with the second rarest terms; a word may meet an alignment but once for each place it can stand in
    both = pairs.join(asked, key, "left_semi").groupBy("doc", "mark", "win", "len", "begin").agg(F.max("exact").alias("exact"))
    alone = begun.where("term2 is null").select("doc", "mark", "win", "len", "begin", F.lit(True).alias("exact")).distinct()
    left = stored(both.unionByName(alone))

    one = F.xxhash64("doc", "mark").alias("_key")
    known = left.select(one).distinct()
    known = F.broadcast(known) if known.count() <= KNOWN else known
    meant = postings.withColumn("_key", one).join(known, "_key", "left_semi")
    others = terms.where("r > 2").select("win", "off", "term")
    rest = left.where("len > 2").join(small(others, n * WINDOW), "win").withColumn("at", nearby(F.col("begin") + F.col("off")))
    rest = rest.select("doc", "mark", "win", "len", "begin", "off", "term", "at.pos", F.col("at.exact").alias("here"), "exact")
    found = rest.join(meant, key, "left_semi")
    if slack:
        found = found.groupBy("doc", "mark", "win", "len", "begin", "exact", "off").agg(F.max("here").alias("here"))
    whole = found.groupBy("doc", "mark", "win", "len", "begin", "exact").agg(F.count("*").alias("n"), F.min("here").alias("here")).where("n = len - 2")
    out = ("doc", "mark", "win", "begin", "len", "exact")
    return stored(left.where("len <= 2").select(*out).unionByName(whole.withColumn("exact", F.col("exact") & F.col("here")).select(*out)))


def hit_words(found: DataFrame) -> DataFrame:
    """(doc, mark, n_hit): words inside any of the occurrences (doc, mark, begin, len), each once."""
    ordered = Window.partitionBy("doc", "mark").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc", "mark", "begin", (F.col("begin") + F.col("len")).alias("end")).distinct()
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(ordered), F.lit(0))))
    return spans.select("doc", "mark", new.alias("new")).groupBy("doc", "mark").agg(F.sum("new").alias("n_hit"))


def judge(index: Index, slack: int = SLACK, id_col: str = "doc_id") -> DataFrame:
    """One row a document: words, words hit, items with windows that occur, and ``n_near``, items with windows that occur but for the places of words."""
    found = matches(index, slack)
    exact = found.where("exact")
    hits = hit_words(exact)
    items = found.groupBy("doc", "mark", "win").agg(F.max("exact").alias("exact")).join(index.items, "win")
    told = items.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_distinct("item").alias("any"))
    each = index.postings.where(F.col("term") == END).select(F.col("doc").alias(id_col), F.coalesce("doc", F.lit(0)).alias("doc"), "mark", F.col("pos").cast("bigint").alias("n_words"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    joined = each.join(told, ["doc", "mark"], "left").join(hits, ["doc", "mark"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), (F.coalesce("any", F.lit(0)) - F.size(names)).cast("bigint").alias("n_near"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return judge(build(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _words_sql(relation: str, key: str) -> str:
    return f"SELECT row_number() OVER () AS row, {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {relation}"


OP12_SQL = f"""WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[s:s + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT t, len(string_split(t, ' ')) AS n FROM items), place AS (SELECT t, n, unnest(string_split(t, ' ')) AS word, unnest(range(n)) AS off FROM win),
p AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
g AS (SELECT row, pos, list(word) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM p),
m AS (SELECT row, pos, n, t FROM (SELECT row, pos, l.n, array_to_string(g[1:l.n], ' ') AS t FROM g JOIN (SELECT DISTINCT n FROM win) l ON len(g) >= l.n) JOIN win USING (n, t)),
h AS (SELECT row, count(DISTINCT hit) AS n_hit FROM (SELECT row, unnest(range(pos, pos + n)) AS hit FROM m) GROUP BY row),
i AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS told FROM m JOIN items USING (t) GROUP BY row),
v AS (SELECT * FROM p WHERE word IN (SELECT word FROM place)), f AS (SELECT word, count(*) AS often FROM v GROUP BY word),
r AS (SELECT place.*, row_number() OVER (PARTITION BY t ORDER BY coalesce(often, 0), off) AS r FROM place LEFT JOIN f USING (word)),
a AS (SELECT DISTINCT row, t, n, pos - off AS first FROM v JOIN r USING (word) WHERE r = 1 AND pos - off >= CASE WHEN n > 1 THEN -{SLACK} ELSE 0 END),
o AS (SELECT DISTINCT a.row, a.t, n, first, off FROM a JOIN r USING (t, n) JOIN v ON v.row = a.row AND v.word = r.word AND v.pos BETWEEN first + off - {SLACK} AND first + off + {SLACK}),
y AS (SELECT row, count(DISTINCT item) AS n_any FROM (SELECT row, t FROM o GROUP BY row, t, n, first HAVING count(*) = n) JOIN items USING (t) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_any, 0) - coalesce(n_items, 0) AS n_near
FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row) LEFT JOIN y USING (row)"""
