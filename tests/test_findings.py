"""What the findings of a review came down to, on tables of a few rows."""

import math
import random
import sys
from collections import Counter

from pyspark.sql import functions as F

from evidex.operators import dedupe, discovery, extract, graph, predict, qa, retrieval, text


def test_follow_ups_take_words_as_sql_does(spark):
    """Word ends beside letters outside ASCII, a long s and a vertical tab; digests by the SQL of followup_context."""
    duckdb = sys.modules.get("duckdb") or __import__("duckdb")
    from evidex.plans.corpus_queries import QUERIES

    said = ["first words here now", "ité dans la chambre noire", "whoıs", "thoſe burning rooms there", "\x0bwho goes", "éit burned rooms quickly there", "does theyé run", "who"]
    table = spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(said)], "conv_id long, turn int, role string, text string")
    base = duckdb.connect()
    base.register("conversations", table.toPandas())
    want = {r[1]: (r[2], r[3]) for r in base.execute(QUERIES["followup_context"][1]).fetchall()}
    got = {r["turn"]: (r["digest"], r["rewritten"]) for r in qa.follow_ups(table).select("turn", F.md5(F.col("question").cast("binary")).alias("digest"), "rewritten").collect()}
    assert got == want


def test_capitals_one_for_one(spark):
    table = spark.createDataFrame([("öß",), ("ﬁx",), ("ᾳa",), ("ŉs",), ("ab",), ("",), (None,)], "x string")
    assert [r[0] for r in table.select(text.upper_case(F.col("x"))).collect()] == ["Öẞ", "ﬁX", "ᾼA", "ŉS", "AB", "", None]


def test_lexical_search_hands_on_only_the_best(spark, monkeypatch):
    """Scores by plain sums, ids with several rows and lengths included; no row for each query and document leaves a block."""
    rng = random.Random(3)
    monkeypatch.setattr(retrieval, "DOCS_AT_ONCE", 40)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 7)
    words = [f"w{k}" for k in range(30)]
    docs = [(i % 140, [w for w in words for _ in range(rng.randint(1, 2)) if rng.random() < (0.9 if w == "w0" else 0.2)]) for i in range(160)] + [(7, ["w1", "w2"]), (7, ["w1", "w3"])]
    asked = {q: rng.sample(words, 12) for q in range(20)}
    table = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string")
    found = retrieval.bm25(table, spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "query int, term string"), top=5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    lists: dict = {}
    for i, ws in docs:
        lists.setdefault((i, len(ws)), Counter()).update(ws)
    df, mean = Counter(w for tf in lists.values() for w in tf), sum(len(ws) for _, ws in docs) / len(docs)
    want = []
    for q, ws in asked.items():
        scores: Counter = Counter()
        for (i, dl), tf in lists.items():
            scores[i] += sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * dl / mean)) for w in ws if tf[w])
        best = sorted((-round(s, 6), i) for i, s in scores.items() if s > 0)[:5]
        want += [(q, i, n + 1, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in found.select("query", "doc", "rank", "score").collect()) == sorted(want)


def test_coverage_is_read_from_runs_once_a_document(spark):
    texts = {1: "Flames SPREAD faster in İstanbul", 2: None, 3: "", 4: "ab", 5: "zz flamespr"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    terms = spark.createDataFrame([(1, ["flames", "ab", "spreading", "spread", "zz"]), (4, ["r in", "é", "", "fast"]), (2, ["faster", "st"]), (3, [])], "query int, terms array<string>")
    hits = spark.createDataFrame([(q, i, 0.5) for q in (1, 2, 3, 4, 9) for i in (*texts, 99)], "query int, doc long, score double")
    c = retrieval.coverage(F.col("text"), F.col("terms"))
    want = hits.join(docs.withColumnRenamed("doc_id", "doc"), "doc").join(terms, "query").select("query", "doc", F.round(c, 6), F.round(F.col("score") + 0.01 * c, 9))
    got = retrieval.rerank(hits, docs, terms)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "contains" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_related_pairs_are_decided_where_they_meet(spark):
    rng = random.Random(4)
    lists = {p: {"all", *(f"c{rng.randint(0, 12)}" for _ in range(rng.randint(0, 5)))} for p in range(40)}
    found = retrieval.related(spark.createDataFrame([(p, c) for p, cs in lists.items() for c in cs], "paper long, concept string"))
    want = []
    for p, cs in lists.items():
        best = sorted((-len(cs & os), o) for o, os in lists.items() if o != p and len(cs & os) >= 2)[:6]
        want += [(p, o, -n, k + 1) for k, (n, o) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # no step of its own makes candidate pairs distinct before their lists are compared
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [paper" in x and "other" in x]


def test_claims_of_a_report_lie_in_one_bounded_part(spark, monkeypatch):
    from evidex.plans import claims

    monkeypatch.setattr(claims, "PART_ROWS", 500)
    rows = claims.by_paper(spark, "/root/testdata/sf0.001")
    placed = rows.select("paper_id", F.spark_partition_id().alias("part"))
    assert rows.rdd.getNumPartitions() >= 12 and placed.groupBy("paper_id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_related_findings_make_no_row_for_each_question(spark):
    from evidex.operators import cards

    claims = spark.createDataFrame([(1, "A", "x", 0.5), (2, "A", "y", 0.25), (3, "B", "x", 1.0), (4, None, None, 1.0)], "paper_id long, condition string, geometry string, confidence double")
    asked = spark.createDataFrame([(1, "A"), (1, "x"), (2, "A"), (2, "y"), (3, "B")], "query int, entity string")
    retrieved = spark.createDataFrame([(1, 2), (3, 3), (2, 4)], "query int, paper_id long")
    found = cards.related_findings(claims, asked, retrieved, roles=("condition", "geometry"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 2.5), (1, 2, 2, 1.75), (2, 1, 2, 2.25), (3, 1, 3, 2.5)]
    assert "finding" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_marks_send_nothing_through_the_driver(spark, monkeypatch):
    """no side of a join that grows with the reports is broadcast, and copies take no part in rounds."""
    rows = [(i, "Miller, J.", ["Flame spread in still air", "Flame spread in still aix", "Smoke of wires"][i % 3], "d" if i % 3 == 2 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, author string, title string, doi string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(dedupe.similar_titles(dedupe.title_classes(table)))
    written, cut = [], dedupe.cut

    def noted(df):
        written.append((df.columns, df.count()))
        return cut(df)

    monkeypatch.setattr(dedupe, "cut", noted)
    told = dedupe.mark(table)
    assert "Broadcast" not in plan(told)
    assert {r["id"]: r["duplicate_of"] for r in told.collect()} == {i: {0: 0, 1: 0, 2: 2}[i % 3] if i > 2 or i == 1 else None for i in range(60)}
    assert [n for columns, n in written if columns == ["id", "c", "doi"]][:2] == [60, 3]


def test_votes_of_the_nearest_come_from_blocks(spark, monkeypatch):
    """F15 F16 F27: votes by plain sums, with ties, far values and odd vectors; of equal values the least ids are all that matters."""
    rng = random.Random(5)
    monkeypatch.setattr(predict, "ROWS_AT_ONCE", 30)
    monkeypatch.setattr(predict, "TILE", 4)
    rows = [(i, f"c{i % 3}", [rng.choice((0.0, 1.0, 1e6 + i % 5)), rng.choice((0.0, 0.5))]) for i in range(150)]
    odd = [(900, "c0", None), (901, "c0", [1.0, None]), (902, "c0", [1.0]), (903, "c1", [float("nan"), 0.0])]
    table = spark.createDataFrame(rows + odd, "id long, label string, v array<double>")
    asked = table.where("id % 10 = 0 and id < 150").select(F.col("id").alias("query"), F.col("v").alias("qv"))

    def told(query, point, rows, k):
        near = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, point))), i, c) for i, c, v in rows if i != query)[:k]
        share = Counter()
        for d, _, c in near:
            share[c] += 1 / (d + 1e-3)
        return {(query, c): w / sum(share.values()) for c, w in share.items()}

    def same(got, want):
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in got)

    votes = predict.knn_votes(table, asked, 7)
    assert "FlatMapCoGroupsInArrow" in votes._jdf.queryExecution().executedPlan().toString()
    want = {x: w for i, _, v in rows if i % 10 == 0 for x, w in told(i, v, rows, 7).items()}
    same({(r["query"], r["label"]): r["share"] for r in votes.collect()}, want)
    named = [(f"n{i}", c, v[0]) for i, c, v in rows]
    few = predict.least_of_each(spark.createDataFrame(named + [("n0", "c0", None)], "id string, label string, x double"), "x", 7)
    assert Counter(r["x"] for r in few.collect()) == {x: min(n, 7) for x, n in Counter(x for _, _, x in named).items()}
    points = spark.createDataFrame([("p", [0.7])], "query string, qv array<double>")
    got = predict.knn_votes(few.select("id", "label", F.array("x").alias("v")), points, 7)
    same({(r["query"], r["label"]): r["share"] for r in got.collect()}, told("p", [0.7], [(i, c, [x]) for i, c, x in named], 7))


def test_quotes_are_compared_where_they_may_stand(spark, monkeypatch):
    """changes are counted only near places that hold enough of a quote; a text comes once, with all its quotes."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    source = " ".join(rng.choice(words) for _ in range(3000))
    altered = lambda at, every: "".join("#" if i % every == every - 1 else c for i, c in enumerate(source[at : at + 200]))
    seen, counted = [], extract.least_changes
    monkeypatch.setattr(extract, "least_changes", lambda short, long: seen.append(len(long)) or counted(short, long))
    quotes = [(source[500:700], True), (altered(7000, 15), True), (altered(9000, 7), False), (altered(len(source) - 190, 40), True), ("z" * 8 + source[:190], True), ("q" * 200, False)]
    assert [extract.nearly_within(q, source) for q, _ in quotes] == [x for _, x in quotes]
    assert seen and max(seen) < 1000 < len(source)
    monkeypatch.undo()
    table = spark.createDataFrame([(k, i, q) for k in (1, 2) for i, (q, _) in enumerate(quotes)] + [(1, 90, "short"), (1, 91, None)], "doc long, pos int, quote string")
    told = extract.quote_guard(table, spark.createDataFrame([(1, source), (2, None), (3, "none")], "doc long, text string"))
    assert {(r["doc"], r["pos"]): r["ok"] for r in told.collect()} == {(1, i): x for i, (_, x) in enumerate(quotes)} | {(2, i): False for i in range(6)} | {(1, 90): False, (1, 91): False}


def test_pairs_and_links_are_made_once(spark, monkeypatch):
    """F33 F34: concepts meet in their report's list, both ways round; links are written once for all steps."""
    rows = [(1, "a", "x"), (1, "b", "y"), (1, "b", "z"), (2, "a", "x"), (2, "b", "y"), (2, "a", "w"), (None, "a", "x"), (None, "b", "y"), (3, "c", "y"), (3, None, "v")]
    pairs = discovery.pair_papers(spark.createDataFrame(rows, "paper long, kind string, concept string"))
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    half = {("a", "x", "b", "y"): 2, ("a", "x", "b", "z"): 1, ("a", "w", "b", "y"): 1}
    assert {tuple(r)[:4]: r["papers"] for r in pairs.collect()} == half | {(k[2], k[3], k[0], k[1]): n for k, n in half.items()}
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or cut(df))
    links = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "s"), ("p", "q")], "a string, b string")
    assert {tuple(r) for r in graph.within(links, ["p"], 2).collect()} == {("p", 0), ("q", 1), ("r", 2)}
    assert written == [["s", "t"]]


def test_passes_read_stored_sentences(spark, monkeypatch):
    """sentences are made once, and each pass over them reads the table written."""
    from evidex.plans import understanding_queries as plans

    plan = []
    axes = plans.L.leading_axes
    monkeypatch.setattr(plans.L, "leading_axes", lambda texts: plan.append(texts._jdf.queryExecution().executedPlan().toString()) or axes(texts, passes=1))
    plans.liked(spark, "/root/testdata/sf0.001")
    assert "table-" in plan[0] and "Generate" not in plan[0]


def test_shards_of_an_index_are_written_and_read_a_few_at_a_time(spark):
    from urllib.parse import unquote, urlparse

    import pyarrow.parquet as pq
    from evidex.llm import lexical

    word = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: F.hex(F.xxhash64("doc_id", x)))
    built = lexical.build(spark.range(24).coalesce(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", word).alias("text")))
    kept = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in built.shards.inputFiles()]
    assert sum(m.num_rows for m in kept) >= 6 and all(m.row_group(k).total_byte_size <= 16 << 20 for m in kept for k in range(m.num_row_groups))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 16 << 20


def test_lexical_blocks_hand_on_what_can_still_be_among_the_best(spark, monkeypatch):
    """From each block came the best of each query, so that what was written grew with queries times blocks; waves of blocks know what others have reached."""
    rng = random.Random(8)
    monkeypatch.setattr(retrieval, "DOCS_AT_ONCE", 12)
    words, told, plain = [f"w{k}" for k in range(40)], [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scored, *a: told.append(scored.count()) or plain(scored, *a))
    table = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, w) for q in range(20) for w in rng.sample(words, 15)], "query int, term string")
    found = retrieval.bm25(table, asked, top=5)
    assert found.count() == 100 and sum(told) < 2000
    monkeypatch.setattr(retrieval, "DOCS_AT_ONCE", 1000)
    assert sorted(found.collect()) == sorted(retrieval.bm25(table, asked, top=5).collect())


def test_texts_go_out_once_and_terms_not_for_each_block(spark, monkeypatch):
    """Texts went out to be joined to their hits and again to meet the terms, which were repeated for each block of texts."""
    docs = spark.createDataFrame([(i, f"Spread{i} flames, ab {i}") for i in range(12)] + [(3, "flames again"), (None, "flames")], "doc_id long, text string")
    terms = spark.createDataFrame([(q, ["flames", "ab", f"spread{q}", None, "zz"][q % 3 :]) for q in range(9)], "query int, terms array<string>")
    hits = spark.createDataFrame([(q, i, q / 4) for q in range(10) for i in (None, *range(0, 14, 2), 3) if i != q], "query int, doc long, score double")
    c = retrieval.coverage(F.col("text"), F.col("terms"))
    want = hits.join(docs.withColumnRenamed("doc_id", "doc"), "doc").join(terms, "query").select("query", "doc", F.round(c, 6), F.round(F.col("score") + 0.01 * c, 9))
    monkeypatch.setattr(retrieval, "TEXTS_AT_ONCE", 4)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 2)
    for sent in (0, 100):
        monkeypatch.setattr(retrieval, "IDS_SENT", sent, raising=False)
        got = retrieval.rerank(hits, docs, terms)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Generate" not in plan and "Join Inner" not in plan and ("Join LeftSemi" in plan) == (sent > 0)
