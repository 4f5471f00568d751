"""Queries that SQL can't express, against plain versions over the smallest tables."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from evidex import catalogue
from evidex.operators import cards, dedupe, extract, graph, predict, qa, text
from evidex.plans import card_queries, corpus_queries, understanding_queries
from evidex.sources import export, records

SF = "/root/testdata/sf0.001"


def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sentences_are_selected_greedily(spark):
    rows = understanding_queries.worth(spark, SF).where("score is not null").collect()
    by_query = defaultdict(list)
    for r in rows:
        by_query[r["query"]].append((-r["score"], r["n"], r["pos"], r["sentence"]))
    want = {}
    for q, found in by_query.items():
        found.sort()
        taken, used, seen = [], defaultdict(int), set()
        for s, n, _, sentence in found:
            if s > found[0][0] + 1.6 or len(taken) == 6:
                break
            key = sentence[:60].lower()
            if key not in seen and used[n] < 2:
                seen.add(key)
                used[n] += 1
                taken.append((n, sentence))
        want |= {(q, k + 1): x for k, x in enumerate(taken)}
    got = {(r["query"], r["rank"]): (r["n"], r["sentence"]) for r in catalogue.queries()["answer_selection"](spark, SF).collect()}
    assert got == want and len(got) > 20


def test_a_sentence_passed_over_for_its_passage_does_not_count(spark):
    long = "the same beginning of sixty characters or more, which both of them share"
    rows = [(1, 1, 0, "a" * 60, 9.0), (1, 1, 1, "b" * 60, 8.9), (1, 1, 2, long, 8.8), (1, 2, 0, long, 8.7), (1, 3, 0, "c" * 60, 7.3)]
    got = qa.selected(spark.createDataFrame(rows, "query int, n int, pos int, sentence string, score double")).orderBy("rank").collect()
    assert [(r["n"], r["sentence"][:3]) for r in got] == [(1, "aaa"), (1, "bbb"), (2, "the")]


def test_chunks_in_the_row_equal_chunks_by_sections(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Summary\n"), "text", F.lit("\n2. Results\n"), "text", F.lit("\nReferences\nx y\nIII. CONCLUSIONS\nend of it"))).otherwise(F.concat(F.lit("Introduction:\n"), "text")).alias("text"))
    table = table.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 40_000), (-4, "a line\n" * 30_000)], "doc_id long, text string"))
    want = text.chunks(text.relabelled(text.sections(text.paragraphs(table)))).collect()
    got = text.document_chunks(table).collect()
    tagged = catalogue.queries()["tagged_chunks"](spark, SF).collect()
    texts = {(r["doc"], r["n"]): r["text"] for r in catalogue.queries()["chunks"](spark, SF).collect()}
    found = lambda p, x: re.search(rf"(?i)(?<![\w-])(?:{p})(?![\w-])", x)
    assert {(r["doc"], r["n"]): r["tags"] for r in tagged} == {k: ",".join(t for t, p in corpus_queries.TERMS.items() if found(p, x)) for k, x in texts.items()} and any(r["tags"] for r in tagged)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r["kind"] for r in got}) >= 4


def plain_findings(sentences):
    match = lambda p: re.compile(rf"(?i)(?<![\w-])(?:{p})(?![\w-])")
    top = lambda vocabulary, s: min(((-len(match(p).findall(s)), i, k) for i, (k, p) in enumerate(vocabulary.items())), default=(0, 0, None))
    out, seen = [], set()
    for pos, s in enumerate(sentences):
        if not 50 <= len(s) <= 600:
            continue
        (n, _, outcome), (m, _, condition) = top(corpus_queries.OUTCOMES, s), top(corpus_queries.CONDITIONS, s)
        if not n:
            continue
        condition = condition if m else None
        met = match(corpus_queries.OUTCOMES[outcome]).search(s)
        near = s[max(met.start() - 70, 0) : met.end() + 70]
        up, down, same = (len(re.findall(corpus_queries.CUES[k], near, re.A)) for k in ("increase", "decrease", "no_change"))
        direction = "no_change" if same else "increase" if up > down else "decrease" if down > up else "mixed" if up else None
        if direction and (condition, outcome, direction) not in seen:
            seen.add((condition, outcome, direction))
            out.append((-round(0.45 + 0.1 * bool(m), 2), pos, condition, outcome, direction, s))
    return [(k + 1, c, o, d, -conf, s) for k, (conf, _, c, o, d, s) in enumerate(sorted(out, key=lambda x: x[:2])[:14])]


def plainly_near(quote, source):
    """Whether a window is alike to 90 per cent, of all that some five characters of the quote place."""
    m = len(quote)
    offsets = {q.start() - i for i in range(m - 4) for q in re.finditer(re.escape(quote[i : i + 5]), source)}
    starts = {k + d for k in offsets for d in range(-m // 10 - 1, m // 10 + 2) if 0 <= k + d <= len(source) - m}
    return any(dedupe.indel_ratio(quote, source[k : k + m]) >= 90 - 1e-9 for k in starts)


def test_findings_and_quotes(spark):
    got = defaultdict(list)
    for r in catalogue.queries()["findings_extract"](spark, SF).collect():
        got[r["doc"]].append(tuple(r)[1:])
    whole = docs(spark)
    for doc, body in whole.items():
        sentences = [s.strip(" ") for s in re.split(text.SENTENCE, body or "")]
        assert sorted(got.get(doc, [])) == sorted(plain_findings([s for s in sentences if s] if all(sentences) else sentences)), doc
    quoted = {r["doc"]: (r["n"], r["ok"]) for r in catalogue.queries()["quote_guard"](spark, SF).collect()}
    given = defaultdict(list)
    for r in corpus_queries.quotes(spark, SF).collect():
        given[r["doc"]].append(r["quote"])
    assert quoted == {d: (len(q), sum(len(x) >= 20 and (x in whole[d] or plainly_near(x, whole[d])) for x in q)) for d, q in given.items()}
    assert 0.5 < sum(ok for _, ok in quoted.values()) / sum(n for n, _ in quoted.values()) < 0.9


def test_betweenness_of_the_claims_graph(spark):
    links = card_queries._edges(spark, SF)
    rows = {(r["a"], r["b"]): r["weight"] for r in graph.undirected(links).where("weight > 3").collect()}
    some = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a string, b string, weight long")
    near = defaultdict(dict)
    for (a, b), w in rows.items():
        near[a][b] = near[b][a] = 1 / w
    import heapq

    between = dict.fromkeys(near, 0.0)
    for s in near:  # shortest paths from each node, counted, then summed backwards
        far, paths, before, order, heap, done = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in near[v].items():
                if u not in far or d + w < far[u] - 1e-12:
                    far[u], paths[u], before[u] = d + w, paths[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif abs(d + w - far[u]) <= 1e-12 and u not in done:
                    paths[u] += paths[v]
                    before[u].append(v)
        share = defaultdict(float)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
    n = len(near)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(some).collect()}
    assert set(got) == set(near)
    close = sum(abs(got[v] - between[v] / ((n - 1) * (n - 2))) < 1e-6 for v in near)
    assert close >= 0.95 * n  # paths of equal length may be told apart by rounding


def test_hedged_sentences_are_no_findings(spark):
    said = ["It has been shown that the spreading of these is rising and going on and on in all.", "The of spreading is the rising and going on and on in all of these places."]
    table = spark.createDataFrame([(1, i, x) for i, x in enumerate(said)], "doc long, pos int, sentence string")
    every, plain = (extract.findings(table, {"the": "the"}, {"of": "of"}, corpus_queries.CUES, hedges=h).collect() for h in ((), extract.HEDGES))
    # the first of equal findings stays
    assert [r["quote"] for r in every] == said[:1] and [r["quote"] for r in plain] == said[1:]


def test_the_fullest_duplicate_stays(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    title = "a long title on flames in low gravity and their spreading"
    rows = [(1, False, 10, title), (2, True, 5, title), (3, True, 50, title + "s"), (4, True, 900, "another one altogether")]
    table = spark.createDataFrame([(i, "Doe, J.", t, None, f, n) for i, f, n, t in rows], "id long, author string, title string, doi string, full_text boolean, word_count int")
    told = {r["id"]: r["duplicate_of"] for r in dedupe.mark(table, order=[~F.col("full_text"), -F.col("word_count")]).collect()}
    assert told == {1: 3, 2: 3, 3: None, 4: None}
    assert {r["id"]: r["duplicate_of"] for r in dedupe.mark(table).collect()} == {1: None, 2: 1, 3: 1, 4: None}


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,title,year\n1,"a ""b""\nc",\n2,,1999\n')
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "p.csv"), ["id", "title", "year"]).orderBy("id").collect()] == [("1", 'a "b"\nc', ""), ("2", "", "1999")]
    (tmp_path / "c.jsonl").write_text('{"id": "a", "n": [1, 2]}\n{"id": "b"}\n')
    lines = records.read_lines(spark, str(tmp_path / "c.jsonl"), "id string, n array<int>")
    assert sorted((r["id"], r["n"]) for r in lines.collect()) == [("a", [1, 2]), ("b", None)]
    assert records.with_vectors(lines, lines.select("id", F.lit(1.0).alias("v")), "id").count() == 2
    assert records.with_vectors(lines, lines.limit(1).select("id", F.lit(1.0).alias("v")), "id") is None


def test_citations_with_all_fields(spark):
    table = spark.createDataFrame([(7, ["Doe, J.", "Roe, R."], "With this flame & fire", 1999, "10.1/x", None)], "id long, author array<string>, title string, year int, doi string, note string")
    (entry,) = (r["entry"] for r in export.bibtex(table, more={"doi": "doi", "note": "note"}).collect())
    assert entry == "@techreport{doe1999flame,\n  author = {Doe, J. and Roe, R.},\n  title = {With this flame \\& fire},\n  year = {1999},\n  doi = {10.1/x}\n}"
    (entry,) = (r["entry"] for r in export.ris(table, more={"DO": "doi", "N1": "note"}).collect())
    assert entry == "TY  - RPRT\nAU  - Doe, J.\nAU  - Roe, R.\nTI  - With this flame & fire\nPY  - 1999\nDO  - 10.1/x\nER  - "


def test_groups_are_listed_contradictory_first(spark):
    rows = [("b", "consensus", 9), ("a", "contradictory", 2), ("c", "contradictory", 5), ("d", "emerging", 9)]
    table = spark.createDataFrame(rows, "id string, status string, n_papers long")
    assert [r["id"] for r in cards.listed(table).collect()] == ["c", "a", "b", "d"]
    assert [r["id"] for r in cards.listed(table, ("consensus", "emerging"), "D").collect()] == ["d"]


def test_answers_for_readers(spark):
    chosen = defaultdict(list)
    for r in catalogue.queries()["answer_selection"](spark, SF).collect():
        chosen[r["query"]].append((r["rank"], r["n"], r["sentence"]))
    got = {r["query"]: r["answer"] for r in catalogue.queries()["answers_for_readers"](spark, SF).collect()}
    assert set(got) == set(chosen)
    for query, rows in chosen.items():
        body = "\n".join(f"- {s} [{n}]" for _, n, s in sorted(rows)[:3])
        places = sorted((m.start(), t) for t in ("the", "tion", "them") if (m := re.search(rf"\b{t}s?\b", body, re.I | re.A)))
        parts = ["What scientists found:", body] + ([f"Words to know: {', '.join(t for _, t in places)}"] if places else [])
        # of a question's ten documents 3, 23, 43 ... flew
        assert got[query] == "\n".join(parts + ([] if query % 2 == 0 else [qa.STUDY_NOTE])), query
    said = spark.createDataFrame([(1, 1, 2, "It burns."), (1, 2, 5, "It stops.")], "query long, rank int, n int, sentence string")
    flown = spark.createDataFrame([(1, "flight"), (1, "ground")], "query long, study_type string")
    assert [r["answer"] for r in qa.rendered(said, "scientist", flown).collect()] == ["It burns. [2] It stops. [5]"]
    assert [r["answer"] for r in qa.rendered(said, "manager", flown).collect()] == ["Bottom line:\n- It burns. [2]\n- It stops. [5]"]
    assert qa.rendered(said.limit(0), "architect", flown).count() == 0


KINDS = {"fuel": {"wax": "wax|paraffin", "linen": "linen"}, "outcome": {"glow": "afterglow time"}}


def test_entities_are_swapped_and_borrowed(spark):
    rows = [("afterglow time of wax and wax", "now linen?"), ("afterglow time", "linen"), ("of linen", "linen"), (None, "linen"), ("", "")]
    got = qa.swapped(spark.createDataFrame(rows, "a string, b string"), "a", "b", KINDS).collect()
    assert [r["swapped"] for r in got] == ["afterglow time of linen and wax", None, None, None, None]
    sides = spark.createDataFrame([("afterglow time of wax", "linen"), ("linen", "afterglow time of paraffin sheets"), ("steel", "iron")], "a string, b string")
    assert [tuple(r) for r in qa.borrowed(sides, KINDS).collect()] == [("afterglow time of wax", "afterglow time of linen"), ("afterglow time of linen sheets", "afterglow time of paraffin sheets"), ("steel", "iron")]
    turns = spark.createDataFrame([(1, 0, "user", "How long is the afterglow time of wax in still air"), (1, 1, "user", "how about linen?"), (1, 2, "user", "and why so?")], "conv_id long, turn int, role string, text string")
    asked = [r["question"] for r in qa.follow_ups(turns, by_type=KINDS).orderBy("turn").collect()]
    assert asked == ["How long is the afterglow time of wax in still air", "How long is the afterglow time of linen in still air", "how about linen? and why so?"]


def test_boosted_classes_over_folds(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i % 3) + (i % 7) / 10, float(i % 5)) for i in range(90)], "id long, label int, x double, y double")
    told = predict.cross_validated(rows, ["x", "y"], "label", "id", 3, n=3, trees=3).collect()
    assert sum(r["n"] for r in told) == 90 and sum(r["n"] for r in told if r["label"] == r["predicted"]) >= 85
    sizes = predict.folds(rows, "label", "id", 4).groupBy("label", "fold").count().collect()
    assert len(sizes) == 12 and {r["count"] for r in sizes} == {7, 8}


def test_context_edges_and_subgraphs_of_odd_claims(spark):
    odd = spark.createDataFrame([(1, "o", ["s", None], "p", ["f"]), (1, "o", ["s"], None, []), (2, None, None, "p", None)], "paper_id long, outcome string, species array<string>, platform string, fuels array<string>")
    got = {tuple(r) for r in graph.context_edges(odd).collect()}
    assert got == {("species:s", "implicated_in", "outcome:o", 1, 2), ("platform:p", "hosted", "fuel:f", 1, 1)}
    assert graph.context_edges(odd.limit(0)).count() == 0
    edges = spark.createDataFrame([("a:1", "r", "b:1", 5), ("b:1", "r", "c:1", 3), ("c:1", "r", "d:1", 9), ("a:1", "r", "d:2", 1)], "src string, rel string, dst string, papers long")
    ends = lambda **how: [(r["src"], r["dst"]) for r in graph.subgraph(edges, **how).collect()]
    assert ends(focus="a:1") == [("a:1", "b:1")] and ends(focus="a:1", depth=2) == [("a:1", "b:1"), ("b:1", "c:1")]
    assert ends(kinds=("a", "b"), nodes=("b:1", "c:1")) == [("b:1", "c:1")] and ends(kinds=("c", "d")) == [("c:1", "d:1")] and ends(least=6, focus="zz:9") == []


#: Queries without SQL, and the tests that hold them against plain versions.
TESTED = {
    "graph_betweenness": "test_betweenness_of_the_claims_graph",
    "graph_communities": "test_operators.py: test_communities_settle_or_take_the_least_of_a_cycle", "chunks": "test_chunks_in_the_row_equal_chunks_by_sections",
    "findings_extract": "test_findings_and_quotes", "quote_guard": "test_findings_and_quotes", "near_duplicate_reports": "test_operators.py: test_copies_and_chains_are_settled_like_the_greedy_rule",
    "answer_selection": "test_sentences_are_selected_greedily", "answers_for_readers": "test_answers_for_readers",
    "tagged_chunks": "test_chunks_in_the_row_equal_chunks_by_sections", "graph_modularity": "test_depth.py: test_modularity_merges_equal_plain_ones", "community_themes": "test_depth.py: test_modularity_merges_equal_plain_ones", "findings_full": "test_depth.py: test_full_findings_equal_plain_ones",
    "regime_boosting": "test_depth.py: test_boosting_equals_plain_trees", "sentence_likeness": "test_depth.py: test_likeness_equals_a_plain_decomposition",
}


def test_every_query_has_sql_or_a_plain_version():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set(TESTED)
