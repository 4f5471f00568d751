"""Lexical search, decontamination and whitening against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evidex.llm import ann, decontaminate, lexical, queries, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, term string, pos int, win long, mark long, doc long, score long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents with further columns that are named as the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "item_id long, text string, terms string, off int")


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    return sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(got) > 0


# --- 11 lexical search


def plain_search(rows, asked, k=50):
    terms = [lexical.TERM.findall((t or "").translate(UPPER)) for _, t in rows]
    n, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for item, text in asked:
        scored = []
        for (doc, _), own in zip(rows, terms, strict=True):
            tf, score = Counter(own), 0
            for x in set(lexical.TERM.findall((text or "").translate(UPPER))):
                if tf[x]:
                    m = 100 - 50 + (50 * len(own) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [8192, 3])
def test_search_equals_plain_scores(spark, monkeypatch, at_once):
    rng = random.Random(2)
    monkeypatch.setattr(lexical, "SHARD_DOCS", at_once)
    word = lambda: "".join(rng.choice("abÉé你7") for _ in range(rng.randrange(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(7, rows[3][1]), (None, rows[3][1]), (100, None), (101, ""), (102, " .,- "), (103, "A a-A_a"), (104, "x" * 9000 + " ab"), (9, rows[9][1])]
    asked = [(1, "a b. É 你7 A"), (2, None), (3, " -"), (None, "zzz ab"), (5, rows[3][1]), (5, "b b b"), (6, "nowhere")]
    got = lexical.search(lexical.build(docs(spark, rows).repartition(3)), items(spark, asked), k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, asked, 10)


def test_search_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    rows = [(i, "same text") for i in range(90, 0, -1)] + [(i, "other") for i in range(200, 210)]
    got = lexical.search(lexical.build(docs(spark, rows).repartition(5)), items(spark, [(i, "same") for i in range(5)]))
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got.collect()) == [(i, k, k) for i in range(5) for k in range(1, 51)]


def test_search_of_empty_tables(spark):
    for d, i in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])):
        assert lexical.search(lexical.build(docs(spark, d)), items(spark, i)).collect() == []


def test_search_matches_sql(spark):
    assert same_as_sql(spark, "op11_lexical_search")


def test_best_keeps_the_smaller_id_of_ties():
    score, ids = np.array([5, 0, 9, 5, 5, 9]), np.array([8, 1, 7, 3, 2, 6])
    assert ids[lexical.best(score, ids, 3)].tolist() == [6, 7, 2]
    assert lexical.best(np.zeros(4, int), ids[:4], 3).tolist() == []


# --- 12 decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_judge(rows, asked):
    """One tuple a document, as the query returns them but for proximity matches."""
    at = defaultdict(set)
    for i, text in asked:
        w = WORD.findall((text or "").translate(UPPER))
        for a in range(max(1, len(w) - 9) if w else 0):
            at[tuple(w[a : a + 10])].add(str(i))
    out = []
    for i, text in rows:
        w, hit, found = WORD.findall((text or "").translate(UPPER)), set(), set()
        for size in {len(k) for k in at}:
            for a in range(len(w) - size + 1):
                if (key := tuple(w[a : a + size])) in at:
                    hit |= set(range(a, a + size))
                    found |= at[key]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_plain_windows(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Été", "x1", "é", "rare" + str(rng.randrange(60))])
    text = lambda n: " ".join(word() for _ in range(n))
    asked = [(k, text(rng.choice([3, 10, 12, 25]))) for k in range(12)] + [(20, None), (21, " .!"), (22, "ÉTÉ-x1"), (23, "alone"), (24, "of of of of of of of of of of of")]
    asked += [(25, asked[0][1]), (10, asked[1][1]), (10, asked[1][1])]
    rows = [(k, text(rng.randrange(0, 60)) + " " + rng.choice(asked[:12])[1].upper().replace("ÉTÉ", "Été") + ", " + text(5)) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "of " * 30), (53, "alone"), (None, rows[1][1]), (None, rows[2][1]), (5, rows[6][1]), (5, rows[6][1]), (54, "of " * 5000 + asked[2][1]), (55, "x " * 50_000)]
    got = decontaminate.judge(decontaminate.build(docs(spark, rows).repartition(3), items(spark, asked)))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == plain_judge(rows, asked)


def test_proximity_matches(spark):
    passage = "a b c d e f g h i j"
    rows = [(1, f"z {passage} z"), (2, "z a b c d e X f g h i j"), (3, "z a b c d e X X X f g h i j"), (4, "b a c d f e g h j i"), (5, "a b c d e f g h i"), (6, passage + " z " + passage)]
    index = decontaminate.build(docs(spark, rows), items(spark, [(1, passage), (2, "q r")]))
    near = {(r["doc"], r["begin"], r["exact"]) for r in decontaminate.matches(index, 2).collect()}
    assert {(d, e) for d, _, e in near} == {(1, True), (2, False), (4, False), (6, True)}
    assert {(d, b) for d, b, e in near if e} == {(1, 1), (6, 0), (6, 11)} == {(r["doc"], r["begin"]) for r in decontaminate.matches(index).collect()}
    assert {r["doc_id"]: r["n_near"] for r in decontaminate.judge(index).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}


def test_decontamination_of_empty_tables_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    for d, i in (([], [(1, "a b")]), ([(1, "a b"), (2, None)], []), ([], []), ([(1, "a b c")], [(1, "b c")])):
        got = decontaminate.judge(decontaminate.build(docs(spark, d), items(spark, i))).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == plain_judge(d, i)


def test_decontamination_matches_sql_without_python(spark):
    assert same_as_sql(spark, "op12_decontamination")
    plan = queries.queries()["op12_decontamination"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- 13 whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double")


def test_whitening_equals_plain_algebra(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) / 5
    good = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[1].tolist()), (900, [0.0] * 40)]
    inf, nan = float("inf"), float("nan")
    bad = [(901, None), (902, []), (903, [1.0] * 39), (904, [nan] + [1.0] * 39), (905, [inf] + [1.0] * 39), (906, [None] + [1.0] * 39), (907, [1e30] * 40)]
    got = whitening.whiten(vectors(spark, good + bad).repartition(5)).toPandas()
    assert len(got) == len(good) * 32 and set(got.n) == {len(good)} and got.identity_error.max() < 1e-9
    own = np.floor(64 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 1_000_000
    values = np.linalg.eigvalsh(np.cov(own.T, bias=True))[::-1]
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / values.sum(), rtol=1e-9)
    ones = got[got.component == 1]
    exact = [int(s) for s in ((len(own) * own.astype(object) - own.astype(object).sum(axis=0)) ** 2).sum(axis=1)]
    assert sorted(ones.deviation) == sorted(exact)
    axis = np.linalg.eigh(np.cov(own.T, bias=True))[1][:, -1]
    plain = (own - own.mean(axis=0)) @ axis / np.sqrt(values[0])
    assert np.allclose(np.sort(np.abs(plain)), np.sort(np.abs(ones.whitened)), atol=1e-9)


def test_whitening_without_variance_and_of_few_rows(spark):
    flat = whitening.whiten(vectors(spark, [(i, [float(i % 2), 1.0, float(i % 2)]) for i in range(6)])).toPandas()
    assert len(flat) == 18 and flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all()
    assert flat.identity_error.max() < 1e-9 and flat[flat.component == 1].explained.iloc[0] == pytest.approx(1.0)
    one = whitening.whiten(vectors(spark, [(5, [0.5, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    assert whitening.whiten(vectors(spark, [])).collect() == whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_large_entries_stay_exact(spark):
    got = whitening.whiten(vectors(spark, [(1, [2.0**50, 0.0]), (2, [0.0, 2.0**51]), (3, [2.0**54, 3.0])])).toPandas()
    assert got[got.component == 1].deviation.isna().all() and got.whitened.notna().all()
    x = whitening.exact(np.array([[1 << 61]]), 8)
    assert x.dtype == object and whitening.squared(whitening.deviations(np.array([[3], [5]]), 2, [8])) == [4, 4]


def test_pairs_of_near_copies_leave_the_groups_once(spark):
    """Near copies meet in nearly all substrings; what leaves the groups are the pairs that plain probing finds, each once."""
    rng = np.random.default_rng(11)
    copies = np.abs(rng.standard_normal(32)) + 0.01 * rng.standard_normal((60, 32))
    vectors = np.vstack([copies, rng.standard_normal((240, 32))])
    model = ann.fit_codes(vectors)
    assert model.tables > 1
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "row long, v array<double>")
    names = entries.where("row % 10 = 0").withColumnRenamed("row", "query")
    pairs = ann._candidates(entries, names, model, len(vectors), 40)
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")[0]
    got = [(r["query"], r["row"]) for r in pairs.collect()]
    codes = model.encode(vectors)
    apart = np.bitwise_count(codes[::10, None] ^ codes[None])
    met = (apart[:, :, : model.tables] <= model.reach).any(axis=2) & (apart.sum(axis=2, dtype=int) <= model.radius)
    assert sorted(got) == sorted((10 * int(q), int(r)) for q, r in np.argwhere(met))
