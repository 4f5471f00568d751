"""Extra columns that are named as an operator's own change nothing, and very long texts are taken whole, operator by operator."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from evidex.llm import ann, bytebpe, langid, packing, quality_model, secrets, simhash, tokenfile, urlfilter

SF = "/root/testdata/sf0.001"
#: Names that the operators give to columns on the way.
OWN = ("id", "t", "fp", "v", "row", "query", "code", "node", "part", "seq", "words", "lengths", "ids", "spans", "host", "path", "score", "rank", "text_", "kept", "start", "value", "prefix", "low", "key", "entry")


def crowded(df):
    """``df`` with many more columns, some of types that nothing expects."""
    for i, name in enumerate(OWN):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("array<int>") if i % 3 == 0 else F.lit("x") if i % 3 == 1 else F.struct(F.lit(1).alias("id")))
    return df


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang")
    return docs.unionByName(spark.createDataFrame([(None, "token = 0123456789abcdef0123456789abcdef", None), (1000, None, "en"), (3, "", None)], docs.schema))


def same(plain, more):
    show = lambda df: sorted(str(tuple(r[c] for c in plain.columns)) for r in df.collect())
    a, b = show(plain), show(more)
    assert a == b and a
    return True


def test_crowded_secrets(table):
    assert same(secrets.find_secrets(table), secrets.find_secrets(crowded(table))) and same(secrets.digest_rows(table), secrets.digest_rows(crowded(table)))
    out = secrets.redact_secrets(crowded(table))
    assert out.columns == crowded(table).columns and same(secrets.redact_secrets(table), out)


def test_crowded_near_duplicates(table):
    assert same(simhash.near_duplicates(table), simhash.near_duplicates(crowded(table)))
    assert same(simhash.keep_one_each(table, shingle=5, similarity=0.8), simhash.keep_one_each(crowded(table), shingle=5, similarity=0.8))


def test_crowded_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    assert same(ann.nearest(rows, rows.where("vec_id % 50 = 0")), ann.nearest(crowded(rows), crowded(rows).where("vec_id % 50 = 0")))


def test_crowded_token_files(spark, table, tmp_path):
    for name, rows in (("a", table), ("b", crowded(table))):
        tokenfile.write_token_files(rows, str(tmp_path / name), P.path("word_bpe_49k.json"))
    assert same(tokenfile.read_token_files(spark, str(tmp_path / "a")), tokenfile.read_token_files(spark, str(tmp_path / "b")))


def test_crowded_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    assert same(urlfilter.judge_urls(pages), urlfilter.judge_urls(crowded(pages)))


def test_crowded_byte_pairs(table):
    ranks = bytebpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain, more = (bytebpe.encode(x, ranks, P.PATTERN) for x in (table, crowded(table)))
    assert same(plain, more) and same(bytebpe.decode(plain, ranks), bytebpe.decode(more, ranks))


def test_crowded_packing(table):
    plain, more = (packing.pack(x, P.path("byte_bpe_50k.json")) for x in (table, crowded(table)))
    pieces = lambda df: sorted(str((r["doc_id"], r["doc_tokens"])) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert pieces(plain) == pieces(more) and plain.agg(F.sum("length")).first() == more.agg(F.sum("length")).first()


def test_crowded_languages_and_quality(spark, table):
    model = langid.fit(table.where("lang is not null and text is not null").select(F.col("doc_id").alias("id"), "text", "lang"))
    assert same(langid.predict(table, model), langid.predict(crowded(table), model))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_model.keep_good(crowded(table), labels)
    assert out.columns == crowded(table).columns and same(quality_model.keep_good(table, labels), out)


def test_very_long_texts_in_duplicates_and_packing(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    words = [word() for _ in range(500_000)]
    long, near = " ".join(words), " ".join(words[:-3] + ["zzz", "yyy", "xxx"])
    rows = spark.createDataFrame([(1, long), (2, near), (3, "short"), (4, long)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in ((1, long), (3, "short"))}
    got = {}
    for r in packing.pack(rows.where("doc_id in (1, 3)"), P.path("byte_bpe_50k.json")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, n in want.items():
        places = np.cumsum([0] + [size for _, size in sorted(got[i])])
        assert [start for start, _ in sorted(got[i])] == places[:-1].tolist() and places[-1] == n
