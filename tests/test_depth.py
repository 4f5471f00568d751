"""Operators that need more than SQL, against plain versions: indexes, quotes, communities, paths, boosting, likeness, pages, references."""

import heapq
import html
import html.entities
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex import catalogue
from evidex.operators import boosting, dedupe, evaluate, extract, graph, likeness, qa, retrieval, text
from evidex.plans import study_queries
from evidex.sources import paged, records

SF = "/root/testdata/sf0.001"

# --- search


def test_blocks_that_cannot_reach_are_passed_over(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 4)
    words = [f"w{k}" for k in range(40)]
    docs = {i: [w for w in words if rng.random() < 0.15] + ["common"] * (i % 3) for i in range(200)} | {500: [], 501: ["the"]}
    table = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()] + [(600, None)], "doc_id long, text string")
    asked = [(q, w) for q in range(6) for w in rng.sample(words, 3)] + [(6, "common"), (7, "nowhere"), (6, "common")]
    index = retrieval.index(table)
    got = {(r["query"], r["doc"]): (r["rank"], r["score"]) for r in retrieval.search(index, spark.createDataFrame(asked, "query int, term string"), 5).collect()}
    kept = {i: [w for w in ws if w != "the"] for i, ws in (docs | {600: []}).items()}
    mean, df = sum(map(len, kept.values())) / len(kept), Counter(w for ws in kept.values() for w in set(ws))
    for q in range(8):
        scored = []
        for i, ws in kept.items():
            tf = Counter(ws)
            score = sum(math.log(1 + (len(kept) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in {w for k, w in asked if k == q} if tf[w])
            if score > 0:
                scored.append((-round(score, 6), i))
        want = [(i, n + 1, -s) for n, (s, i) in enumerate(sorted(scored)[:5])]
        assert [(i, n, s) for (k, i), (n, s) in sorted(got.items(), key=lambda x: x[1]) if k == q] == want
    assert index.agg(F.max(F.size("docs"))).first()[0] < 16 and retrieval.bm25(table.limit(0), spark.createDataFrame(asked, "query int, term string")).count() == 0


def test_dense_search_keeps_ties_and_bears_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    vectors += [(1000 + i, vectors[7][1]) for i in range(6)] + [(2000, None), (2001, [1.0] * 7)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = rows.where("vec_id in (7, 20, 2000)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    got = defaultdict(list)
    for r in retrieval.dense(rows, asked, top=4).orderBy("rank").collect():
        got[r["query"]].append((r["doc"], r["score"]))
    usable = [(i, v) for i, v in vectors if v and len(v) == 8]
    for q in (7, 20):
        own = dict(usable)[q]
        want = sorted(((-round(float(np.dot(v, own)), 6), i) for i, v in usable))[:4]
        assert got[q] == [(i, -s) for s, i in want if s < 0]
    assert set(got) == {7, 20} and [i for i, _ in got[7]] == [7, 1000, 1001, 1002]


def test_queries_without_hits_count_in_every_mean(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query int, doc long, rank int")
    good = spark.createDataFrame([(1, 11)], "query int, doc long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    got = {r["query"]: (r["hit1"], r["hit3"], r["rr"], r["p5"]) for r in evaluate.rank_metrics(hits, good, queries).collect()}
    assert got == {1: (0, 1, 0.5, 0.5), 2: (0, 0, 0.0, 0.0), 3: (0, 0, 0.0, 0.0)}
    papers = spark.createDataFrame([(10, 5), (11, 5), (12, 6)], "doc long, paper long")
    assert sorted((r["query"], r["doc"], r["rank"]) for r in evaluate.by_paper(hits, papers).collect()) == [(1, 5, 1), (2, 6, 1)]
    left = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 3, 1)], "query int, doc long, rank int")
    assert sorted(map(tuple, qa.interleaved(left, hits.where("query = 1 and rank = 1")).collect())) == [(1, 1, 10, 0)]


def test_confidence_rounds_ties_half_up(spark):
    rows = spark.createDataFrame([(m, c, f, p) for m in range(101) for c in range(5) for f in (0, 1) for p in range(7)], "m int, c int, f int, p int")
    got = rows.select("m", "c", "f", "p", qa.confidence(F.col("m") / 100.0, F.col("c") / 4, F.col("f") == 1, F.col("p")).alias("s")).collect()
    from decimal import ROUND_HALF_UP, Decimal

    exact = lambda r: Decimal("0.55") * r["m"] / 100 + Decimal("0.25") * r["c"] / 4 + Decimal("0.1") * r["f"] + Decimal("0.1") * min(Decimal(r["p"]) / 5, Decimal(1))
    assert all(r["s"] == float(exact(r).quantize(Decimal("0.001"), ROUND_HALF_UP)) for r in got)


# --- findings and quotes


def plain_evidence(rows, profile, roles, implied):
    match = lambda p: re.compile(rf"(?i)(?<![\w-])(?:{p})(?![\w-])")

    def ranked(role, s):
        counted = sorted((-len(match(p).findall(s)), i, k) for i, (k, p) in enumerate(roles[role].items()))
        return [k for n, _, k in counted if n]

    out, seen = [], set()
    hedge = re.compile(r"\b(?:" + "|".join(extract.HEDGES) + r")\b", re.I)
    for pos, kind, s in sorted(rows):
        if kind not in extract.FINDING_SECTIONS or not 50 <= len(s) <= 600 or hedge.search(s) or not (named := ranked("outcome", s)):
            continue
        outcome = named[0]
        met = match(roles["outcome"][outcome]).search(s)
        near = s[max(0, met.start() - 70) : met.end() + 70]
        up, down = (len(re.findall(p, near)) for p in (extract.INCREASE, extract.DECREASE))
        side = "no_change" if re.search(extract.NO_CHANGE, near) else next((d for p, d in implied.get(outcome, {}).items() if re.search(p, s, re.I)), None)
        side = side or ("increase" if up > down else "decrease" if down > up else "mixed" if up else None)
        own = {r: ranked(r, s)[:1] for r in extract.ROLES}
        full = {r: (own[r] or profile[r][:1] or [None])[0] for r in extract.ROLES}
        key = (full["condition"], outcome, side, *own["geometry"])
        if not side or not full["condition"] or key in seen:
            continue
        seen.add(key)
        held = re.search(extract.PREVENT, s) or re.search(extract.NOT_PREVENT, s)
        means = (ranked("countermeasure", s) or [None])[0] if held else None
        effect = None if means is None else "ineffective" if re.search(extract.NOT_PREVENT, s) else "effective"
        sure = round(0.45 + 0.1 * sum(map(bool, own.values())) + 0.1 * (kind in ("ABSTRACT", "RESULTS")), 2)
        out.append((-sure, extract.FINDING_SECTIONS.index(kind), pos, (*(full[r] for r in extract.ROLES), outcome, side, ranked("species", s)[:3], means, effect, s, kind, sure)))
    return [(n + 1, *x[3]) for n, x in enumerate(sorted(out, key=lambda x: x[:3])[:14])]


def test_full_findings_equal_plain_ones(spark):
    sentences, profiles = study_queries._told_claims(spark, SF)
    by_doc, known = defaultdict(list), {}
    for r in sentences.collect():
        by_doc[r["doc"]].append((r["pos"], r["kind"], r["sentence"]))
    for r in profiles.collect():
        known[r["doc"]] = {"fuel": r["fuels"], "condition": r["conditions"], "geometry": r["geometries"]}
    got = defaultdict(list)
    for r in catalogue.queries()["findings_full"](spark, SF).collect():
        got[r["doc"]].append(tuple(r)[1:])
    kinds = Counter()
    for doc, rows in by_doc.items():
        want = plain_evidence(rows, known.get(doc, {r: [] for r in extract.ROLES}), study_queries.ROLES, study_queries.IMPLIED)
        assert sorted(got[doc]) == want, doc
        kinds.update((x[5], x[8]) for x in want)
    assert {d for d, _ in kinds} == {"increase", "decrease", "no_change", "mixed"} and {e for _, e in kinds} == {None, "effective", "ineffective"}


def test_quotes_nearly_within_equal_all_windows():
    rng = random.Random(8)

    def plain(quote, source, least=90):
        short, long = sorted((quote, source), key=len)
        m = len(short)
        windows = [long[i : i + m] for i in range(len(long) - m + 1)] + [long[:k] for k in range(1, m)] + [long[-k:] for k in range(1, m)]
        return any(200 * slow(short, w) >= least * (m + len(w)) for w in windows)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    verdicts = Counter()
    for _ in range(250):
        source = "".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 90)))
        a = rng.randrange(len(source))
        quote = list(source[a : a + rng.randrange(1, 45)])
        for _ in range(rng.randrange(0, 1 + len(quote) // 5)):
            k = rng.randrange(len(quote))
            quote[k] = rng.choice(("", quote[k] + "z", "y"))
        quote = "".join(quote)
        if quote:
            assert dedupe.indel_ratio(quote, source) == pytest.approx(200 * slow(quote, source) / (len(quote) + len(source)))
            got = extract.nearly_within(quote, source)
            assert got == plain(quote, source), (quote, source)
            verdicts[got] += 1
    assert min(verdicts.values()) > 20 and not extract.nearly_within("", "a") and not extract.nearly_within("a", None)


# --- graph


def random_links(spark, seed, n=40, p=0.15):
    rng = random.Random(seed)
    group = [rng.randrange(5) for _ in range(n)]
    rows = [(f"n{a:02d}", f"n{b:02d}", rng.randrange(1, 30)) for a in range(n) for b in range(a) if rng.random() < (0.6 if group[a] == group[b] else p)]
    return rows, spark.createDataFrame(rows, "a string, b string, weight long")


def plain_modularity(rows, community, resolution=1.2):
    total, degree = sum(w for *_, w in rows), defaultdict(float)
    for a, b, w in rows:
        degree[community[a]] += w
        degree[community[b]] += w
    return sum(w for a, b, w in rows if community[a] == community[b]) / total - resolution * sum((k / (2 * total)) ** 2 for k in degree.values())


def plain_greedy(rows, resolution=1.2):
    """The pair that gains most merges, one at a time."""
    community = {x: x for a, b, _ in rows for x in (a, b)}
    while True:
        best = (plain_modularity(rows, community, resolution) + 1e-12, None)
        for a, b in {tuple(sorted((community[a], community[b]))) for a, b, _ in rows if community[a] != community[b]}:
            moved = {x: a if c == b else c for x, c in community.items()}
            best = max(best, (plain_modularity(rows, moved, resolution), (a, b)), key=lambda x: x[0])
        if best[1] is None:
            return community
        community = {x: best[1][0] if c == best[1][1] else c for x, c in community.items()}


def test_modularity_merges_equal_plain_ones(spark):
    for seed in (1, 2, 3):
        rows, links = random_links(spark, seed, 28)
        near = {r["node"]: r["community"] for r in graph.modularity_communities(links).collect()}
        told = plain_modularity(rows, near)
        assert told >= 0.95 * plain_modularity(rows, plain_greedy(rows))
        if seed == 1:  # the same by joins alone
            assert {r["node"]: r["community"] for r in graph.modularity_communities(links, few=0).collect()} == near
            members = spark.createDataFrame(list(near.items()), "node string, community int")
            assert graph.modularity(links, members) == pytest.approx(told)
        sizes = Counter(near.values())
        assert [n for _, n in sorted(sizes.items())] == sorted(sizes.values(), reverse=True) and set(sizes) == set(range(len(sizes)))
    assert graph.modularity_communities(links.limit(0)).collect() == [] and graph.modularity(links.limit(0), members) == 0.0


def plain_paths(rows, source, target, k):
    """Simple paths in the order of their lengths, best first."""
    near = defaultdict(dict)
    for a, b, w in rows:
        near[a][b] = near[b][a] = w
    heap, out = [(0.0, [source])], []
    while heap and len(out) < 4 * k:
        length, path = heapq.heappop(heap)
        if path[-1] == target:
            out.append((round(length, 9), " > ".join(path), min(near[a][b] for a, b in zip(path, path[1:], strict=False))))
            continue
        for b, w in near[path[-1]].items():
            if b not in path:
                heapq.heappush(heap, (length + 1 / w, [*path, b]))
    return sorted(out)[:k]


def test_shortest_paths_equal_plain_ones(spark):
    for seed in (4, 5):
        rows, links = random_links(spark, seed, 24, 0.08)
        got = [(r["length"], r["path"], r["support"]) for r in graph.shortest_paths(links, "n00", "n13", 5, at_once=7).collect()]
        assert got == plain_paths(rows, "n00", "n13", 5) and len(got) == 5
    chain = [("a", "b", 10), ("b", "c", 10), ("c", "d", 10), ("d", "e", 10), ("e", "f", 10), ("a", "x", 2), ("x", "f", 2), ("y", "z", 9)]
    links = spark.createDataFrame(chain, "a string, b string, weight long")
    got = [(r["path"], r["length"], r["support"]) for r in graph.shortest_paths(links, "a", "f").collect()]
    assert got == [("a > b > c > d > e > f", 0.5, 10), ("a > x > f", 1.0, 2)]  # five hops are shorter than two
    assert graph.shortest_paths(links, "a", "y").collect() == graph.shortest_paths(links, "a", "nowhere").collect() == []
    edges = spark.createDataFrame([("m", "mitigates", "o", 5), ("m", "fails_to_mitigate", "o", 2), ("o", "r", "m", 9), ("o", "r", "p", 1)], "src string, rel string, dst string, papers long")
    assert sorted(map(tuple, graph.weakest(edges).collect())) == [("m", "o", 2), ("o", "p", 1)] and graph.weakest(edges, 2).count() == 1


# --- boosting and likeness


def plain_boost(x, y, classes, trees):
    """Softmax boosting row by row, with exhaustive splits."""

    def tree(rows, residual, depth):
        below = sum(abs(residual[i]) * (1 - abs(residual[i])) for i in rows)
        leaf = (classes - 1) / classes * sum(residual[i] for i in rows) / below if below > 1e-150 else 0.0
        best = (1e-9, None)
        for f in range(len(x[0])) if depth else ():
            for cut in sorted({x[i][f] for i in rows})[:-1]:
                left, right = [i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]
                apart = sum(residual[i] for i in left) / len(left) - sum(residual[i] for i in right) / len(right)
                gain = len(left) * len(right) / len(rows) * apart**2
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, left, right, f, cut)
        if best[1] is None:
            return lambda row: leaf
        one, two, f, cut = tree(best[1], residual, depth - 1), tree(best[2], residual, depth - 1), best[3], best[4]
        return lambda row: one(row) if row[f] <= cut else two(row)

    prior = [math.log(max(sum(v == k for v in y) / len(y), 1e-12)) for k in range(classes)]
    stages = []
    score = lambda row: [prior[k] + 0.08 * sum(s[k](row) for s in stages) for k in range(classes)]
    for _ in range(trees):
        p = [np.exp(s) / np.exp(s).sum() for s in (np.array(score(row)) for row in x)]
        stages.append([tree(range(len(x)), [(y[i] == k) - p[i][k] for i in range(len(x))], 3) for k in range(classes)])
    return score


def test_boosting_equals_plain_trees(spark):
    rng = random.Random(2)
    x = [[rng.randrange(5), rng.randrange(4), rng.randrange(2)] for _ in range(70)]
    y = [(a[0] + a[1] * a[2] + rng.randrange(2)) % 3 for a in x]
    cells = sorted(set(map(tuple, x)))
    counts = np.array([[sum(tuple(r) == c and v == k for r, v in zip(x, y, strict=True)) for k in range(3)] for c in cells], float)
    got = boosting.fit(np.array(cells), counts, trees=12).scores(np.array(cells))
    score = plain_boost(x, y, 3, 12)
    assert np.allclose(got, [score(c) for c in cells], atol=1e-9)
    # in all: folds, bins, categories; a rule that trees can learn
    rows = spark.createDataFrame([(f"r{i}", float(i % 10), None if i % 13 == 0 else float(i % 7), ("wood", "wool", None)[i % 3], ("a", "b", "c")[(i % 10 > 4) + (i % 3 == 0)]) for i in range(300)] + [("r300", 1.0, 1.0, "wood", "other")], "key string, u double, v double, m string, label string")
    told = boosting.cross_validated(rows, ("u", "v"), "label", "key", ("a", "b", "c"), "m", ("wood", "wool"), trees=30)
    assert told.count() == 300 and told.where("label = predicted").count() >= 295
    row = boosting.accuracy(told).first()
    assert row["accuracy"] >= 0.98
    assert boosting.cross_validated(rows.limit(0), ("u",), "label", "key", ("a", "b")).count() == 0
    assert boosting.cross_validated(rows.where("label = 'a'"), ("u",), "label", "key", ("a", "b")).where("predicted = 'a'").count() == rows.where("label = 'a'").count()
    with pytest.raises(ValueError, match="cells"):
        old, boosting.CELLS = boosting.CELLS, 5
        try:
            boosting.cross_validated(rows, ("u", "v"), "label", "key", ("a", "b", "c"))
        finally:
            boosting.CELLS = old


def test_likeness_equals_a_plain_decomposition(spark):
    rng = random.Random(7)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    said = [" ".join(rng.choice(topics[k % 6]) for _ in range(9)) for k in range(240)] + ["", None, "...", "t0w1"]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, sentence string").repartition(5)
    axes = likeness.leading_axes(table, axes=6, passes=12)
    a = likeness.counts(said)
    _, size, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.linalg.norm(a @ axes, axis=0), size[:6], rtol=1e-2)
    want = a @ right[:6].T
    got = {r["i"]: r["c"] for r in table.select("i", likeness.likeness(F.col("sentence"), F.lit("t1w1 t1w2 t2w3"), axes).alias("c")).collect()}
    q = likeness.counts(["t1w1 t1w2 t2w3"]) @ right[:6].T
    for i in range(len(said)):
        norm = np.linalg.norm(want[i]) * np.linalg.norm(q)
        assert abs(got[i] - (float(want[i] @ q[0]) / norm if norm > 1e-9 else 0.0)) < 0.02
    assert likeness.leading_axes(table.limit(0)).shape == (likeness.COLUMNS, likeness.AXES)
    rows = catalogue.queries()["sentence_likeness"](spark, SF).collect()
    assert len({r["likeness"] for r in rows}) > 100 and all(-1.0 <= r["likeness"] <= 1.0 for r in rows)


# --- sources and texts


def test_pages_are_read_as_a_client_would(spark, tmp_path):
    def page(query, start, ids, total):
        results = [{"id": i, "title": f"T{i}", "authors": [{"name": "Z", "sequence": 1}], "publications": [], "downloads": None} for i in ids]
        (tmp_path / f"{paged.slug(query)}__from{start:05d}.json").write_text(json.dumps({"query": query, "from": start, "response": {"results": results, "stats": {"total": total}}}))

    page("Cool flames!", 0, [1, 2, 3], 5)
    page("Cool flames!", 3, [4, "5"], 5)
    page("Cool flames!", 5, [99], 5)  # beyond the total
    page("empty", 0, [], 0)
    page("other", 0, [2, 7], 2)
    read = paged.read_result_pages(spark, str(tmp_path))
    assert sorted((r["query"], r["start"], r["pos"], r["rec"]["id"]) for r in read.collect()) == [("Cool flames!", 0, 0, "1"), ("Cool flames!", 0, 1, "2"), ("Cool flames!", 0, 2, "3"), ("Cool flames!", 3, 0, "4"), ("Cool flames!", 3, 1, "5"), ("other", 0, 0, "2"), ("other", 0, 1, "7")]
    assert sorted(r["rec"]["id"] for r in paged.read_result_pages(spark, str(tmp_path), 4).collect()) == ["1", "2", "2", "3", "4", "7"]
    assert sorted(r["rec"]["title"] for r in paged.read_result_pages(spark, str(tmp_path), query="Other").collect()) == ["T2", "T7"]
    assert len(paged.PageReader({"path": str(tmp_path)}).partitions()) == 3 and len(paged.PageReader({"path": str(tmp_path), "query": "other"}).partitions()) == 1
    assert {r["id"]: r["queries"] for r in records.flat(records.merge_pages(read)).collect()}["2"] == "Cool flames!; other"


def test_profiles_by_grouping_sets_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("", 1, 3.0), (None, None, None)], "k string, y int, v double")
    got = {(r["set"], r["key"]): (r["n"], r["v"]) for r in records.profiled(rows, {"all": (), "k": ("k",), "both": ("k", "y")}, v=F.col("v")).collect()}
    assert got == {("all", ""): (3, 5.0), ("k", "a"): (1, 2.0), ("k", "unknown"): (2, 3.0), ("both", "a/1"): (1, 2.0), ("both", "unknown/1"): (1, 3.0), ("both", "unknown/unknown"): (1, None)}
    assert records.profiled(rows.limit(0), {"all": (), "k": ("k",)}).collect() == []


def test_every_reference_is_resolved(spark):
    rng = random.Random(1)
    said = [f"x&{k}y&{k}" for k in html.entities.html5] + [f"a&#{n};b&#x{n:X};c&#X{n:x} &#{n}z" for n in (*range(3000), *rng.sample(range(0x120000), 7000), 10**9, 0x110000, 0xD800)]
    said += ["&&amp;lt;", "&notit;", "&#;", "&#x;", "& ", "", "&ampx", "&AMP", "plain", "&" + "a" * 50 + ";", "&#00000000000065;", "&notin;&notinva", "&;", "&amp" * 9]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, x string").union(spark.createDataFrame([(-1, None)], "i int, x string"))
    got = {r["i"]: r["u"] for r in rows.select("i", text.unescaped(F.col("x")).alias("u")).collect()}
    assert got.pop(-1) is None and all(got[i] == html.unescape(x) for i, x in enumerate(said))


def test_reports_are_parsed_as_surveyed(spark):
    long = "Word after word of the report stands here and goes on for a good while. "
    report = "\r\nA title\n\n" + long + "It was hyphen-\nated [1, 2-4] (see Doe et al., 1999a; Roe & Poe 2001) and seen (Figs. 2A, 3) .\n\n2. METHODS\n" + long + "\n\nIII. Results and discussion:\n\n"
    report += "Table 2: what was measured (Doe 1999) in all of the many runs\n\nshort\n\n1.2 3.4 5.6 7.8 9.0 11.2 13.4 15.6 17.8 19.0 x\n\nIntroduction . . . . . . 12, and what follows in the rest\n\n" + long * 30 + "\n\nExperiments were made by many\n\n"
    report += "References\n\n" + long + "\n\nConclusions\n\n" + long
    rows = spark.createDataFrame([(1, report), (2, None), (3, ""), (4, "\n\n".join([long] * 4)), (5, "Background\n" + "\n\n".join([long] * 4)), (6, "References\n\n" + long + "\n\nSummary\n" + long), (7, "\n\n".join([long * 600] * 3))], "doc_id long, text string")
    got = {}
    for r in text.report_sections(rows).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append((r["kind"], r["block"]))
    plain = long.strip()
    assert got[1][0] == ("INTRO", plain + " It was hyphenated and seen.") and got[1][1] == ("METHODS", plain)
    assert got[1][2] == ("FIG", "Table 2: what was measured (Doe 1999) in all of the many runs") and got[1][3:] == [("RESULTS", (long * 30).strip())]
    assert [k for k, _ in got[4]] == ["DISCUSS"] * 4 and [k for k, _ in got[5]] == ["INTRO", "INTRO", "DISCUSS", "DISCUSS"]
    assert got[6] == [("ABSTRACT", plain)] and len(got[7]) == 2 and set(got) == {1, 4, 5, 6, 7}
    chunks = text.report_chunks(rows.where("doc_id = 1")).orderBy("n").collect()
    assert [r["kind"] for r in chunks][:3] == ["INTRO", "METHODS", "FIG"] and all(len(r["text"].split()) <= 180 for r in chunks) and sum(len(r["text"].split()) for r in chunks) == sum(len(t.split()) for _, t in got[1])
