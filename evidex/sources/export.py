"""Exports: flattened tables, reference formats, multi-format sinks and logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_DATASETS = ("findings", "consensus")
#: Characters that TeX reads as commands.
TEX_SPECIAL = "&%$#_{}"


def flattened(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as text; arrays joined by semicolons, unknown columns left out."""
    kinds = dict(rows.dtypes)
    return rows.select(*((F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in columns if c in kinds))


def tex(value: Column) -> Column:
    return F.regexp_replace(value, f"([{TEX_SPECIAL}])", r"\\$1")


#: Words that don't make a citation key.
KEY_STOP = ("about", "from", "into", "over", "some", "that", "their", "these", "this", "under", "upon", "with")


def bibtex(rows: DataFrame, key: str = "id", author: str = "author", title: str = "title", year: str = "year", journal: str | None = None, more: Mapping[str, str] | None = None) -> DataFrame:
    """(id, entry): one entry each; fields without a value are left out.

    ``author`` may be an array: its names are joined by "and", the first makes the key, with the
    year and the title's first word of four letters that is no stop word.  ``more`` adds fields,
    such as ``{"institution": "center", "doi": "doi", "url": "url", "note": "note"}``, in its order.
    """
    if dict(rows.dtypes)[author].startswith("array"):
        rows = rows.withColumn(author, F.array_join(author, " and "))
    name = F.lower(F.regexp_replace(F.substring_index(F.col(author), ",", 1), "[^A-Za-z]", ""))
    word = F.coalesce(F.get(F.filter(F.transform(F.regexp_extract_all(F.col(title), F.lit(r"\b([A-Za-z]{4,})\b"), F.lit(1)), F.lower), lambda w: ~w.isin(*KEY_STOP)), F.lit(0)), F.lit(""))
    kind = F.when(F.col(journal).isNotNull(), "article").otherwise("techreport") if journal else F.lit("techreport")
    fields = [("author", author), ("title", title), ("year", year)] + ([("journal", journal)] if journal else []) + list((more or {}).items())
    lines = F.array_compact(F.array(*(F.when(F.length(F.col(c).cast("string")) > 0, F.concat(F.lit(f"  {n} = {{"), tex(F.col(c).cast("string")), F.lit("}"))) for n, c in fields)))
    entry = F.concat(F.lit("@"), kind, F.lit("{"), name, F.coalesce(F.col(year).cast("string"), F.lit("")), word, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return rows.select(F.col(key).alias("id"), entry.alias("entry"))


def ris(rows: DataFrame, key: str = "id", author: str = "author", title: str = "title", year: str = "year", more: Mapping[str, str] | None = None) -> DataFrame:
    """(id, entry) of tag lines; a null has no line.  An array of authors gives a line each; ``more`` maps tags such as DO, UR, AB to columns."""
    names = F.col(author) if dict(rows.dtypes)[author].startswith("array") else F.array(author)
    authors = F.transform(F.filter(names, lambda a: a.isNotNull()), lambda a: F.concat(F.lit("AU  - "), a))
    tagged = [F.concat(F.lit(f"{tag}  - "), F.col(c).cast("string")) for tag, c in [("TI", title), ("PY", year), *(more or {}).items()]]
    lines = F.array_compact(F.concat(F.array(F.lit("TY  - RPRT")), F.coalesce(authors, F.array().cast("array<string>")), F.array(*tagged, F.lit("ER  - "))))
    return rows.select(F.col(key).alias("id"), F.array_join(lines, "\n").alias("entry"))


def write_all(rows: DataFrame, folder: str, formats: tuple[str, ...] = ("json", "csv", "parquet")) -> None:
    for f in formats:
        out = rows.write.mode("overwrite")
        getattr(out.option("header", True) if f == "csv" else out, f)(f"{folder}/{f}")


def export(rows: DataFrame, dataset: str, fmt: str, path: str) -> None:
    """CSV only for flat data sets."""
    if fmt == "csv" and dataset not in CSV_DATASETS:
        raise ValueError(f"{dataset} has no csv form")
    write_all(flattened(rows, rows.columns) if fmt == "csv" else rows, path, (fmt,))


def append_log(records: DataFrame, path: str) -> None:
    records.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def votes_flattened(groups: DataFrame, labels: DataFrame, fields: tuple[str, ...] = ("condition", "outcome")) -> DataFrame:
    """(id, fields, status, n_papers, increase, decrease, no_change, mixed) as text: the map ``votes`` in four columns, zero where it says nothing.

    ``labels`` (id, label), a short list, names the ids in ``fields``; an id without a label stays.
    """
    out = groups
    for f in fields:
        named = labels.select(F.col("id").alias(f), F.col("label").alias(f"_{f}"))
        out = out.join(named, f, "left").withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    sides = (F.coalesce(F.try_element_at("votes", F.lit(k)), F.lit(0)).cast("string").alias(k) for k in ("increase", "decrease", "no_change", "mixed"))
    return out.select("id", *fields, "status", F.col("n_papers").cast("string").alias("n_papers"), *sides)
