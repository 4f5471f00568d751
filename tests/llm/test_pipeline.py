"""The pipeline's stages against plain versions of their decisions."""

import re

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from evidex.llm import secrets

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, before, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < out.count() <= before.count()
        if k == 2:
            kept = {r["doc_id"]: shingles(r["text"]) for r in out.collect()}
            every = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            gone = set(every) - set(kept)
            alike = lambda a, b: len(a & b) / max(1, len(a | b))
            assert all(alike(a, b) < 0.95 for i, a in kept.items() for j, b in kept.items() if i < j)
            assert gone and all(max(alike(every[i], b) for j, b in every.items() if j != i) > 0.7 for i in gone)
        before = out
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert not any(secrets.Scanner().spans(t) for t in texts.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    got = dict.fromkeys(want, 0)
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == want and np.all([r["length"] <= 1024 for r in pieces])


def test_stages_bear_nulls_repeats_and_extra_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "w " * 300_000, None, "s", 600_000)], docs.schema)
    for table in (docs.limit(0), docs.where("doc_id < 40").unionByName(docs.where("doc_id < 5")).unionByName(odd)):
        before = table.withColumn("_q_code", F.lit("x")).withColumn("_fp", F.lit("y")).withColumn("stats", F.lit(1))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, before, SF)
            path = str(tmp_path / f"{table.columns.index('text')}-{k}-{len(out.columns)}-{id(table)}")
            out.write.parquet(path)
            before = spark.read.parquet(path)
        if table.isEmpty():
            assert before.count() == 0
        else:
            assert before.count() > 0
