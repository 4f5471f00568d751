"""Bibliographic records: scans, merging of result pages, projection and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, title string, abstract string, center string, stiType string, "
    "authors array<struct<name:string,sequence:int>>, "
    "publications array<struct<publicationDate:string,issuePublicationDate:string,doi:string>>, "
    "downloads array<struct<mimetype:string,link:string>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of every cached result page, with its file and place."""
    pages = spark.read.schema(f"query string, results array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return pages.select(F.input_file_name().alias("file"), "query", F.posexplode("results").alias("pos", "rec"))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a file with a header, all as text; quoted fields may span lines, empty fields are empty texts."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', emptyValue="").csv(path).na.fill("")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line of JSON; lines that aren't JSON fail the read rather than go missing."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_vectors(passages: DataFrame, vectors: DataFrame, key: str) -> DataFrame | None:
    """Passages with their vectors, or None if the vectors are stale: not one for each passage."""
    joined = passages.join(vectors, key)
    return joined if passages.count() == vectors.count() == joined.count() else None


def merge_pages(pages: DataFrame) -> DataFrame:
    """The first record of each id in file order, and the distinct queries that found it."""
    return pages.groupBy(F.col("rec.id").alias("id")).agg(F.min_by("rec", F.struct("file", "pos")).alias("rec"), F.array_sort(F.collect_set("query")).alias("queries"))


def first_year(publications: Column) -> Column:
    dates = F.transform(publications, lambda p: F.coalesce(p["publicationDate"], p["issuePublicationDate"]))
    return F.substring(F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)), 1, 4).try_cast("int")


def flat(records: DataFrame) -> DataFrame:
    """Flat, printable columns: authors in sequence, white space collapsed, first link and identifier."""
    r = "rec."
    ordered = F.transform(F.array_sort(F.transform(r + "authors", lambda a: F.struct(a["sequence"].alias("s"), a["name"].alias("n")))), lambda a: a["n"])
    pdf = F.get(F.filter(r + "downloads", lambda d: d["mimetype"] == "application/pdf"), F.lit(0))["link"]
    doi = F.get(F.filter(F.transform(r + "publications", lambda p: p["doi"]), lambda d: d.isNotNull()), F.lit(0))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return records.select("id", tidy(F.col(r + "title")).alias("title"), first_year(F.col(r + "publications")).alias("year"), F.array_join(ordered, "; ").alias("authors"), tidy(F.col(r + "abstract")).alias("abstract"), F.col(r + "center").alias("center"), pdf.alias("pdf_url"), doi.alias("doi"), F.array_join("queries", "; ").alias("queries"))


def with_fallback_text(papers: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Texts from the first of two folders that has one, by id, else none."""
    one, two = first.select("id", F.col("text").alias("_1")), second.select("id", F.col("text").alias("_2"))
    return papers.join(one, "id", "left").join(two, "id", "left").select(*papers.columns, F.coalesce("_1", "_2").alias("full_text"))


def pending(papers: DataFrame, done: DataFrame) -> DataFrame:
    """Those without a cached result."""
    return papers.join(done, "id", "left_anti")


def audit(rows: DataFrame, year: str, kind: str) -> DataFrame:
    """(measure, key, n): total, missing years, and counts by year, decade and kind, in one pass."""
    y = F.col(year).cast("string")
    each = F.explode(
        F.array(
            F.struct(F.lit("total").alias("measure"), F.lit("all").alias("key")),
            F.struct(F.when(y.isNull(), "no_year").otherwise("year").alias("measure"), F.coalesce(y, F.lit("none")).alias("key")),
            F.struct(F.lit("decade").alias("measure"), F.concat(F.substring(y, 1, 3), F.lit("0s")).alias("key")),
            F.struct(F.lit("kind").alias("measure"), F.col(kind).alias("key")),
        )
    ).alias("x")
    return rows.select(each).select("x.*").where("key is not null").groupBy("measure", "key").agg(F.count("*").alias("n"))


def audit_measures(rows: DataFrame, texts: DataFrame, short: int = 200) -> DataFrame:
    """(measure, n): records, links, abstracts, years and texts that are there or missing.

    ``rows`` has (id, year, abstract, pdf), ``texts`` (id, text); empty fields count as missing.
    """
    there = lambda c: F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))
    size = F.length(F.trim("text"))
    one = rows.agg(
        F.count("*").alias("records"), F.count_if(there("pdf")).alias("with_pdf"), F.count_if(~there("pdf")).alias("without_pdf"), F.count_if(~there("pdf") & ~there("abstract")).alias("without_pdf_and_abstract"),
        F.count_if(~there("abstract")).alias("without_abstract"), F.count_if(~there("year")).alias("without_year"),
    )
    two = texts.agg(F.count("text").alias("texts"), F.count_if(size < short).alias("short_texts"), F.coalesce(F.sum(size), F.lit(0)).alias("text_chars"))
    pending_texts = rows.where(there("pdf")).join(texts.where("text is not null"), "id", "left_anti").agg(F.count("*").alias("not_extracted"))
    each = lambda one_row: one_row.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in one_row.columns)), F.array(*one_row.columns))).alias("measure", "n"))
    return each(one).unionByName(each(two)).unionByName(each(pending_texts))


def profiled(rows: DataFrame, sets: dict[str, Sequence[str]], none: str = "unknown", **measures: Column) -> DataFrame:
    """(set, key, n, and each of ``measures``): rows and sums of expressions by several groupings at once, from one pass.

    ``sets`` names the columns of each grouping, none of them for the whole; keys of several columns are joined by a slash.
    Nulls and empty texts count under ``none``.  An empty table gives no rows.
    """
    fields = sorted({c for columns in sets.values() for c in columns})
    text = rows.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none)).alias(f"_{c}") for c in fields), *(m.alias(k) for k, m in measures.items()))
    rolled = text.groupingSets([[F.col(f"_{c}") for c in columns] for columns in sets.values()], *(F.col(f"_{c}") for c in fields)).agg(F.grouping_id().alias("_gid"), F.count("*").alias("n"), *(F.sum(k).alias(k) for k in measures))
    # a bit is set for each column that a grouping leaves out
    gid = {name: sum(1 << (len(fields) - 1 - i) for i, c in enumerate(fields) if c not in columns) for name, columns in sets.items()}
    name = F.lit(None).cast("string")
    for k, v in gid.items():
        name = F.when(F.col("_gid") == v, k).otherwise(name)
    whole = rolled.select(name.alias("set"), F.concat_ws("/", *(F.col(f"_{c}") for c in fields)).alias("key"), "n", *measures)
    return whole


def source_audit(found: DataFrame, rows: DataFrame, files: DataFrame, texts: DataFrame, failures: DataFrame, short: int = 200) -> DataFrame:
    """(measure, key, n): all that an audit of a source tells.

    ``found`` has (query, total) of each page of results, ``rows`` the flat records (id, year, abstract, pdf, sti_type,
    center), ``files`` (id, bytes) of the documents fetched, ``texts`` (id, text) of those read, ``failures`` a row for
    each that failed.  Records are counted in one pass by grouping sets.
    """
    there = lambda c: F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))
    one = lambda c: c.cast("bigint")
    year = F.nullif(F.col("year").cast("string"), F.lit(""))
    measured = profiled(
        rows.withColumn("_y", year).withColumn("_d", F.concat(F.substring(year, 1, 3), F.lit("0s"))).withColumn("_c", F.coalesce(F.nullif("center", F.lit("")), F.lit("none"))),
        {"records": (), "year": ("_y",), "decade": ("_d",), "type": ("sti_type",), "center": ("_c",)},
        with_pdf=one(there("pdf")), without_pdf=one(~there("pdf")), without_pdf_and_abstract=one(~there("pdf") & ~there("abstract")), without_abstract=one(~there("abstract")), without_year=one(~there("year")),
    )
    sums = ("with_pdf", "without_pdf", "without_pdf_and_abstract", "without_abstract", "without_year")
    groups = measured.where("set <> 'records'").select(F.col("set").alias("measure"), "key", "n")
    whole = measured.where("set = 'records'").select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.lit("all").alias("key"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for k, c in (("records", "n"), *((s, s) for s in sums))))).alias("x")).select("x.*")
    size = F.length(F.trim("text"))
    fetched = files.agg(F.count("*").alias("fetched"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("fetched_bytes"))
    read = texts.where("text is not null").agg(F.count("*").alias("texts"), F.count_if(size < short).alias("short_texts"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("text_chars"))
    failed = failures.agg(F.count("*").alias("failures"))
    missing = rows.where(there("pdf")).join(files, "id", "left_anti").agg(F.count("*").alias("not_fetched"))
    hits = found.groupBy("query").agg(F.max("total").cast("bigint").alias("n")).select(F.lit("hits").alias("measure"), F.col("query").alias("key"), "n")
    each = lambda t: t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.lit("all").alias("key"), F.col(c).alias("n")) for c in t.columns))).alias("x")).select("x.*")
    out = groups.unionByName(whole).unionByName(hits)
    for t in (fetched, read, failed, missing):
        out = out.unionByName(each(t))
    return out
