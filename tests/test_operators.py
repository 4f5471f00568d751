"""Edge cases of the evidence operators on small tables."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from evidex import catalogue
from evidex.functions import formatting
from evidex.operators import consensus, coverage, dedupe, extract, graph, predict, qa, retrieval, risk, text
from evidex.plans import corpus_queries
from evidex.sources import export, records
from evidex.streaming import logs

SF = "/root/testdata/sf0.001"


def claims(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, condition string, outcome string, geometry string, direction string, confidence double, w double, year int, study_type string, fuel string, seconds double")


def claim(paper, direction, conf=0.9, w=1.0, geometry="g", year=2000, study="flight", fuel="f", seconds=10.0):
    return (paper, "c", "o", geometry, direction, conf, w, year, study, fuel, seconds)


def test_one_vote_per_paper_and_null_group(spark):
    df = claims(spark, [claim(1, "increase", 0.5), claim(1, "decrease", 0.9), claim(1, "mixed", 1.0), claim(2, "decrease", geometry=None), claim(3, "decrease", geometry=None)])
    got = {r["id"]: r for r in consensus.groups(consensus.votes(df)).collect()}
    assert list(got) == ["c|o|None"] and got["c|o|None"]["n_papers"] == 2
    assert {r["direction"] for r in consensus.votes(df).where("paper_id = 1").collect()} == {"decrease"}


def test_status_by_weight_and_ties(spark):
    df = claims(spark, [claim(1, "increase", w=3.0), claim(2, "decrease"), claim(3, "decrease"), claim(4, "increase", w=1.0)])
    row = consensus.groups(consensus.votes(df)).first()
    assert (row["majority"], row["status"], row["minority"]) == ("increase", "contradictory", 2)
    tie = consensus.groups(consensus.votes(claims(spark, [claim(1, "increase"), claim(2, "decrease")]))).first()
    assert tie["majority"] == "increase" and tie["status"] == "emerging"


def test_consensus_threshold(spark):
    four = [claim(i, "increase") for i in range(4)]
    assert consensus.groups(consensus.votes(claims(spark, [*four, claim(9, "decrease")]))).first()["status"] == "consensus"
    assert consensus.groups(consensus.votes(claims(spark, four[:2]))).first()["status"] == "emerging"


def test_upper_median(spark):
    for n, want in ((3, 2.0), (4, 3.0)):
        df = claims(spark, [claim(i, "increase", seconds=float(i + 1)) for i in range(n)])
        assert coverage.duration_gap(df, "condition").first()["median"] == want


def test_under_covered_and_empty(spark):
    cells = spark.createDataFrame([("a", "x", 10, 0), ("b", "x", 10, 0), ("a", "y", 10, 0)], "row string, col string, papers long, flight long")
    assert [(r["row"], r["col"]) for r in coverage.undercovered(cells).collect()] == [("b", "y")]
    assert coverage.undercovered(cells.limit(0)).count() == 0


def test_paths_are_simple_and_betweenness(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 4), ("c", "d", 2)], "a string, b string, weight long")
    got = [r["path"] for r in graph.strongest_paths(links, "a", "d", 3, 3).collect()]
    assert got == ["a > c > d", "a > b > c > d"]
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(links).collect()}
    assert abs(between["c"] - 2 / 3) < 1e-9 and between["a"] == 0
    in_blocks = {r["node"]: r["betweenness"] for r in graph.betweenness(links, sources_per_block=1).collect()}
    assert all(abs(in_blocks[k] - between[k]) < 1e-12 for k in between) and graph.betweenness(links.limit(0)).count() == 0
    rank = {r["node"]: r["rank"] for r in graph.pagerank(links, iterations=30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and max(rank, key=rank.get) == "c"


def ring(spark, tmp_path, n, extra=()):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(f"n{i:02}", f"n{i + 1:02}", 1 + i % 3) for i in range(n)] + list(extra)
    return rows, spark.createDataFrame(rows, "a string, b string, weight long")


def test_pagerank_converges_by_default(spark, tmp_path):
    rows, links = ring(spark, tmp_path, 12, [("n00", "n05", 9)])
    near = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    want = dict.fromkeys(near, 1 / len(near))
    for _ in range(100):
        want = {v: 0.15 / len(near) + 0.85 * sum(want[u] * near[u][v] / sum(near[u].values()) for u in near[v]) for v in near}
    got = {r["node"]: r["rank"] for r in graph.pagerank(links).collect()}
    assert set(got) == set(want) and max(abs(got[v] - want[v]) for v in want) < 1e-9


def test_communities_settle_or_take_the_least_of_a_cycle(spark, tmp_path):
    for n, extra in ((14, []), (14, [("n02", "n09", 5)]), (1, [])):
        rows, links = ring(spark, tmp_path, n, extra)
        near, states = {}, []
        for a, b, w in rows:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
        label = {v: v for v in near}
        while label not in states:
            states.append(label)
            score = {v: {} for v in near}
            for v in near:
                for u, w in near[v].items():
                    score[v][label[u]] = score[v].get(label[u], 0) + w
            label = {v: min(score[v], key=lambda x, v=v: (-score[v][x], x)) for v in near}
        cycle = states[states.index(label) :]
        assert {r["node"]: r["label"] for r in graph.communities(links).collect()} == {v: min(s[v] for s in cycle) for v in near}


def test_exposure(spark):
    p = spark.createDataFrame([("m", 100, 90, 0, 34.0, 56.5)], "mission string, duration_days int, microgravity_days int, partial_gravity_days int, o2_percent double, pressure_kpa double")
    got = {r["condition"]: r["exposure"] for r in risk.exposures(p).collect()}
    assert got["elevated_o2"] == 1.0 and got["low_pressure"] == 1.0 and got["microgravity"] == 0.5
    assert tuple(risk.atmosphere(p).first())[1:] == (8.2, 19.2)


def test_text_steps(spark):
    df = spark.createDataFrame([("Flames [1, 2-4] spread (Smith et al., 1999) fast (Fig. 2A) .",)], "t string")
    assert df.select(text.strip_citations(F.col("t"))).first()[0] == "Flames spread fast."
    assert df.select(text.dehyphenate(F.lit("ex-\nample"))).first()[0] == "example"
    doc = spark.createDataFrame([(1, "lead\n1. Introduction\nwords here\nResults\nmore words")], "doc_id long, text string")
    parts = text.sections(text.paragraphs(doc)).orderBy("pos").collect()
    assert [(r["kind"], r["block"]) for r in parts] == [("BODY", "lead"), ("INTRO", "words here"), ("RESULTS", "more words")]


def test_chunks_reset_and_split(spark):
    long = " ".join(f"W{i} " + " ".join(["x"] * 9) + "." for i in range(40))
    df = spark.createDataFrame([(1, 0, "A", "one two"), (1, 1, "A", long), (1, 2, "B", "end")], "doc long, pos int, kind string, block string")
    got = text.chunks(df).orderBy("n").collect()
    assert got[-1]["text"] == "end" and got[0]["kind"] == "A"
    assert " ".join(r["text"] for r in got[:-1]) == "one two " + long
    assert all(len(r["text"].split()) <= 1.3 * 180 for r in got)


def test_hyphen_is_part_of_a_word(spark):
    df = spark.createDataFrame([(1, "micro-flame flame, Flame. éflame")], "doc_id long, text string")
    assert extract.tag_counts(df, {"flame": "flame"}).first()["n"] == 2


def test_findings_keep_first_and_direction(spark):
    s = "the burning and moving flames were of rising and growing strength in all of them"
    df = spark.createDataFrame([(1, 0, s), (1, 1, s)], "doc long, pos int, sentence string")
    got = extract.findings(df, {"flames": "flames"}, {"of": "of"}, corpus_queries.CUES).collect()
    assert len(got) == 1 and got[0]["direction"] == "increase" and got[0]["confidence"] == 0.55


def test_numbers(spark):
    df = spark.createDataFrame([("24 drop tests and 3 parabolas, 99999 tests",)], "t string")
    assert df.select(extract.n_tests(F.col("t"))).first()[0] == 24


def test_greedy_near_duplicates(spark):
    rows = [(1, "Ann Lee", "alpha beta gamma delta epsilon zeta", None), (2, "Lee, A.", "zeta epsilon delta gamma beta alpha", None), (3, "Lee, A.", "something else", "d"), (4, "Other", "x", "d"), (5, "", "x y z", None), (6, "", "x y z", None)]
    got = {r["id"]: r["duplicate_of"] for r in dedupe.mark(spark.createDataFrame(rows, "id long, author string, title string, doi string")).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 5}


def greedy(rows):
    """(id, author, title, doi) rows, every pair compared: the plain meaning of mark."""
    kept, out = [], {}
    norm = lambda t: " ".join(sorted(re.findall("[a-z0-9]+", t.lower())))
    for i, author, title, doi in sorted(rows):
        like = (k for k, a, t, d in kept if (doi and doi == d) or (a == author and dedupe.indel_ratio(t, norm(title)) >= 95))
        out[i] = next(like, None)
        if out[i] is None:
            kept.append((i, author, norm(title), doi))
    return out


def marked(spark, rows, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = dedupe.mark(spark.createDataFrame(rows, "id long, author string, title string, doi string")).collect()
    assert len(got) == len(rows)
    return {r["id"]: r["duplicate_of"] for r in got}


def test_copies_and_chains_are_settled_like_the_greedy_rule(spark, tmp_path):
    base = "abcdefghij klmnopqrst uvwxyzabcd efghijklmn"
    chain = [base[:k] + "0" * k + base[k:] for k in range(20)]  # each like the next few only: many rounds
    rows = [(k + 1, "lee", t, None) for k, t in enumerate(chain)]
    rows += [(100 + k, "lee", t, None) for k, t in enumerate(chain)]  # copies, also of duplicates
    rows += [(200, "lee", chain[1], "d"), (201, "ng", "else", "d"), (202, "ng", "else", None)]
    assert marked(spark, rows, tmp_path) == greedy(rows)


def test_titles_changed_in_every_long_word_meet(spark, tmp_path):
    words = ["characterisation", "extinguishment", "microgravitational", "thermogravimetric"]
    long = " ".join([*words, *(f"w{i}x" for i in range(22))])
    changed = " ".join([*(w[:4] + "q" + w[5:] for w in words), *(f"w{i}x" for i in range(22))])
    rng = random.Random(5)
    rows = [(1, "lee", long, None), (2, "lee", changed, None), (3, "ng", changed, None)]
    for i in range(4, 120):
        t = list(rng.choice((long, changed))[: rng.randrange(5, 160)])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice(("", "z", t[at] + "z"))
        rows.append((i, "lee", "".join(t), None))
    want = greedy(rows)
    assert want[2] == 1 and sum(v is not None for v in want.values()) > 5
    assert marked(spark, rows, tmp_path) == want


def test_indel_ratio_is_lcs():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        want = 100.0 if not a + b else 200 * lcs(a, b) / len(a + b)
        assert abs(dedupe.indel_ratio(a, b) - want) < 1e-9


def test_fusion_cap_and_ties(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, doc long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 13, 3)], "query int, doc long, rank int")
    fused = retrieval.fuse(one, two)
    assert fused.orderBy(F.desc("score"), "doc").first()["doc"] == 11
    group = spark.createDataFrame([(d, "r") for d in (10, 11, 12)] + [(13, "q")], "doc long, report string")
    assert [r["doc"] for r in retrieval.capped(fused, group).orderBy("rank").collect()] == [11, 10, 13]


def test_every_hundredth_document_is_a_search(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = {i: [w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) >= 2 and w not in retrieval.STOP_WORDS.split()] for i, t in docs.items()}
    mean, df = sum(map(len, words.values())) / len(words), Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for q in (i for i in docs if i % 100 == 0):
        for i, ws in words.items():
            tf = Counter(ws)
            score = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words[q]) & set(ws))
            if score > 0:
                want[q // 100 + 1, i] = score
    got = {(r["query"], r["doc"]): r["score"] for r in catalogue.queries()["bm25_topk"](spark, SF).collect()}
    assert {q for q, _ in got} == {q for q, _ in want} and len(got) == sum(min(200, sum(k == q for k, _ in want)) for q in {q for q, _ in want})
    assert all(abs(v - want[k]) < 1e-4 for k, v in got.items())


def test_refusal_boundary(spark):
    hits = spark.createDataFrame([(1, 1, 1 / 3), (2, 1, 0.34)], "query int, rank int, coverage double")
    asked = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, None)], "query int, domain boolean")
    more = hits.union(spark.createDataFrame([(4, 1, 0.79), (5, 1, 0.8)], hits.schema))
    assert {r["query"]: r["refuse"] for r in qa.refuses(more, asked).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_comparison_and_citations(spark):
    df = spark.createDataFrame([("difference between paper fires and cotton fires?", "so [1] and [9]")], "q string, a string")
    row = df.select(qa.comparison(F.col("q")).alias("s"), qa.citations(F.col("a"), F.lit(3)).alias("c")).first()
    assert row["s"] == ["paper fires", "cotton fires"] and row["c"]["valid"] == [1] and row["c"]["invalid"] == [9]


def test_regime_units_and_boosting(spark):
    df = spark.createDataFrame([("flame spread then extinguished",), ("no spread",), ("it grows",), ("nothing",)], "q string")
    assert [r[0] for r in df.select(predict.regime(F.col("q"))).collect()] == ["marginal", "marginal", "spread", None]
    assert abs(spark.range(1).select(predict.to_kpa(F.lit(14.7), F.lit("psi"))).first()[0] - 101.353) < 1e-2
    train = spark.createDataFrame([(float(i % 10), float(i % 3), i % 10 // 5) for i in range(60)], "x double, y double, label int")
    model = predict.fit_boosted(train, ["x", "y"], "label", 2, trees=3)
    assert model.transform(train).where("prediction = label").count() == 60


def test_records_and_exports(spark, tmp_path):
    page = '{"query": "q%d", "results": [{"id": "1", "title": " A  b", "authors": [{"name": "Z", "sequence": 2}, {"name": "Y", "sequence": 1}], "publications": [{"issuePublicationDate": "1999-01"}], "downloads": []}]}'
    for i in (1, 2):
        (tmp_path / f"p{i}.json").write_text(page % i)
    row = records.flat(records.merge_pages(records.read_pages(spark, str(tmp_path)))).first()
    assert (row["title"], row["year"], row["authors"], row["queries"]) == ("A b", 1999, "Y; Z", "q1; q2")
    df = spark.createDataFrame([(1, "Lee, A.", "On 50% fires & smoke", 2001)], "id long, author string, title string, year int")
    assert "50\\% fires \\& smoke" in export.bibtex(df).first()["entry"] and export.ris(df).first()["entry"].startswith("TY  - RPRT\nAU  - Lee")
    export.export(df, "findings", "csv", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True).count() == 1


def test_formatting(spark):
    row = spark.range(1).select(formatting.lower_label(F.lit("NASA Big Fire")), formatting.duration(F.lit(7200)), formatting.mentions(F.lit("Smoke, flames"), ["flame", "smoke"])).first()
    assert tuple(row) == ("NASA big fire", "2 h", ["smoke", "flame"])


def test_stream_rolls_up_like_batch(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, h, 5), "a", float(h)) for h in range(6)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    logs.write_hourly(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    done, batch = spark.read.parquet(str(tmp_path / "out")), logs.hourly(df)
    assert done.count() >= 3 and done.exceptAll(batch).count() == 0
