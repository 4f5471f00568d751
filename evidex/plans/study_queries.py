"""Queries of studies, experiments, readers' answers and records, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.functions import formatting
from evidex.functions.lineage import cut, shared_folder
from evidex.operators import consensus as C
from evidex.operators import boosting, dedupe, predict, qa
from evidex.operators import coverage as V
from evidex.operators import extract as X
from evidex.operators import graph as G
from evidex.operators import text as T
from evidex.plans.claims import claims, read
from evidex.plans.corpus_queries import TERMS, _docs, _vectors
from evidex.plans.evidence_queries import _ID, EDGE_ROWS, GROUPS, VOTES, W
from evidex.plans.understanding_queries import _WS, BY_TYPE, _by_count, _quoted, worth
from evidex.sources import export, paged, records

#: What the words of the test prose stand for.
PLATFORMS = {"orbital": "than|que", "short": "the|les", "ground": "and|die", "model": "ing|und"}
BY_OUTCOME = {"1": "spread", "2": "spread", "3": "no_spread", "4": "marginal"}
TYPICAL = {"Brand#11": (34.0, 56.5, 5.0), "Brand#12": (21.0, 70.3, 10.0)}
BETTER = {"direction": ("increase", "decrease"), "effect": ("effective", "unknown")}
GLOSSARY = ["the", "tion", "them"]
FUELS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _context(s, d):
    """Claims with two species, one of them at times null, a platform and two fuels."""
    species = F.array(F.concat(F.lit("sp"), (F.col("suppkey") % 7).cast("string")), F.when(F.col("partkey") % 3 == 0, F.concat(F.lit("sp"), (F.col("partkey") % 11).cast("string"))))
    platform = F.when(F.col("suppkey") % 4 != 0, F.concat(F.lit("pl"), (F.col("suppkey") % 5).cast("string")))
    return claims(s, d).select("paper_id", "outcome", species.alias("species"), platform.alias("platform"), F.array("fuel", "geometry").alias("fuels"))


def _experiments(s, d):
    """Findings with a quote, and their reports with an atmosphere or an abstract."""
    found = claims(s, d).withColumn("k", F.col("paper_id") * 10 + F.col("line"))
    quote = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("No spread at "), F.col("k") % 130, F.lit(" % O2 and "), F.col("k") % 37, F.lit(".5 psi.")))
        .when(F.col("k") % 5 == 1, F.concat(F.lit("Flames propagate at "), F.col("k") % 3, F.lit(" atm."))).when(F.col("k") % 5 == 2, "The flame did not grow.")
    )
    flow = F.when(F.col("k") % 3 == 0, "opposed flow").when(F.col("k") % 3 == 1, "quiescent")
    findings = found.select(F.col("k").alias("finding"), F.col("paper_id").alias("paper"), "condition", "outcome", flow.alias("geometry"), "fuel", quote.alias("quote"))
    order = F.col("o_orderkey")
    atmosphere = F.when(order % 4 == 0, F.concat(order % 90, F.lit(" % O2, "), order % 2500, F.lit(" kPa")))
    return findings, read(s, d, "orders").select(order.alias("paper"), atmosphere.alias("atmosphere"), F.when(order % 7 == 0, "Burned in 30% oxygen at 10.2 psi").alias("abstract"))


_EXPERIMENTS = """, f AS (SELECT paper_id * 10 + line AS k, * FROM claims),
q AS (SELECT k AS finding, paper_id AS paper, condition, outcome, fuel, CASE k % 3 WHEN 0 THEN 'opposed flow' WHEN 1 THEN 'quiescent' END AS geometry,
  CASE k % 5 WHEN 0 THEN 'No spread at ' || k % 130 || ' % O2 and ' || k % 37 || '.5 psi.' WHEN 1 THEN 'Flames propagate at ' || k % 3 || ' atm.' WHEN 2 THEN 'The flame did not grow.' END AS quote FROM f),
o AS (SELECT o_orderkey AS paper, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 || ' % O2, ' || o_orderkey % 2500 || ' kPa' END AS atmosphere, CASE WHEN o_orderkey % 7 = 0 THEN 'Burned in 30% oxygen at 10.2 psi' END AS abstract FROM orders),
m AS (SELECT *, concat_ws(' ', coalesce(atmosphere, ''), coalesce(quote, ''), coalesce(abstract, '')) AS said, regexp_matches(lower(quote), 'no spread|extinguish|did not') AS no, regexp_matches(lower(quote), 'spread|propagat|grow') AS yes FROM q JOIN o USING (paper)),
v AS (SELECT *, list_filter(list_transform(regexp_extract_all(said, '(\\d+(?:\\.\\d+)?)\\s*%\\s*(?:O2|oxygen)', 1), lambda x: x::DOUBLE), lambda x: x BETWEEN 10 AND 100)[1] AS oxy,
  list_filter(list_transform(regexp_extract_all(said, '(\\d+(?:\\.\\d+)?\\s*(?:kPa|psi|atm|bar))\\b', 1), lambda x: regexp_extract(x, '^(\\d+(?:\\.\\d+)?)', 1)::DOUBLE * CASE regexp_extract(x, '([A-Za-z]+)$', 1) WHEN 'kPa' THEN 1.0 WHEN 'psi' THEN 6.89476 WHEN 'atm' THEN 101.325 ELSE 100.0 END::DOUBLE), lambda x: x BETWEEN 5 AND 2000)[1] AS kpa,
  CASE WHEN outcome IN ('1', '2', '3', '4') THEN coalesce(CASE WHEN no AND yes THEN 'marginal' WHEN no THEN 'no_spread' WHEN yes THEN 'spread' END, CASE outcome WHEN '3' THEN 'no_spread' WHEN '4' THEN 'marginal' ELSE 'spread' END) END AS regime FROM m)
SELECT finding, paper, condition, outcome, fuel, regime, round(coalesce(oxy, CASE condition WHEN 'Brand#11' THEN 34.0 ELSE 21.0 END::DOUBLE), 3) AS oxygen, round(coalesce(kpa, CASE condition WHEN 'Brand#11' THEN 56.5 WHEN 'Brand#12' THEN 70.3 ELSE 101.3 END::DOUBLE), 3) AS pressure,
  CASE WHEN geometry = 'opposed flow' THEN CASE condition WHEN 'Brand#12' THEN 10.0 ELSE 8.0 END WHEN geometry = 'quiescent' THEN 0.0 WHEN condition = 'Brand#12' THEN 10.0 ELSE 5.0 END::DOUBLE AS flow,
  CASE WHEN oxy IS NULL THEN 'imputed' ELSE 'measured' END AS oxygen_source, CASE WHEN kpa IS NULL THEN 'imputed' ELSE 'measured' END AS pressure_source FROM v WHERE regime IS NOT NULL""".replace("\\\\", "\\")


def _told(s, d):
    """Classes of the vectors whose id is divisible by 50, told from all others."""
    rows = predict.scaled(_vectors(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"))
    asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("query"), F.col("v").alias("qv"), F.col("label").alias("own"))
    votes = predict.knn_votes(rows, asked.drop("own"))
    return predict.voted_classes(votes).join(asked.select("query", F.col("own").alias("label")), "query")


def _swept(s, d):
    """At 26 shares of oxygen: the class of the nearest claims, and whether the share lies among those measured."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("paper_id", "line", "partkey", "suppkey", "direction")))
    every = claims(s, d).select(key.alias("id"), F.col("direction").alias("label"), (F.col("confidence").cast("double") * 30).alias("oxygen"))
    rows = cut(predict.least_of_each(every, "oxygen", 25))  # each value stays, so the range does
    grid = predict.sweep(predict.envelope(rows, ("oxygen",)), 10.0, 40.0).withColumn("query", F.concat(F.lit("point "), "i"))
    votes = predict.knn_votes(rows.select("id", "label", F.array("oxygen").alias("v")), grid.select("query", F.array("value").alias("qv")), 25)
    return grid.join(predict.voted_classes(votes), "query").select("i", "value", "inside", "predicted", "share")


def _turns(s, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(s, d, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before is not null")


def _swap_sql(base: str, new: str, source: str) -> str:
    """Steps that swap type by type; the swapped text ends in ``out``."""
    edge = r"[^\p{L}\p{N}_-]"
    steps = [f"s0 AS (SELECT *, {base} AS out, false AS hit FROM {source})"]
    for i, vocabulary in enumerate(BY_TYPE.values()):
        word = " ".join(f"WHEN '{k}' THEN regexp_extract({new}, '(?i)(?:^|{edge})({p})(?:$|{edge})', 1)" for k, p in vocabulary.items())
        replaced = " ".join(f"WHEN '{k}' THEN regexp_replace(out, '(?i)(^|{edge})(?:{p})($|{edge})', '\\1' || word || '\\2')" for k, p in vocabulary.items())
        steps.append(f"n{i} AS (SELECT *, {_WS.format('out')} AS wo, {_WS.format(new)} AS wn FROM s{i})")
        steps.append(f"w{i} AS (SELECT *, ({_by_count(vocabulary, 'wn')})[1] AS wanted, {_by_count(vocabulary, 'wo')} AS there FROM n{i})")
        steps.append(f"o{i} AS (SELECT *, list_filter(there, lambda e: e <> wanted)[1] AS old, CASE wanted {word} END AS word FROM w{i})")
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (out, hit, wo, wn, wanted, there, old, word), CASE old {replaced} ELSE out END AS out, hit OR old IS NOT NULL AS hit FROM o{i})")
    return ", ".join(steps)


def _answer_rows(s, d):
    kinds = read(s, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("query"), F.when(F.col("doc_id") % 20 == 3, "flight").otherwise("ground").alias("study_type"))
    return qa.selected(worth(s, d)), kinds


def _found_records(s, d):
    """Two overlapping result lists of pages, as records with their files and places."""
    k = F.col("page_id")
    rec = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit(" A  title\n of "), F.col("url")).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("about "), k)).alias("abstract"), F.lit("C").alias("center"), F.lit("report").alias("stiType"),
        F.array(F.struct(F.lit("Roe, R.").alias("name"), F.lit(2).alias("sequence")), F.struct(F.lit("Doe, J.").alias("name"), F.lit(1).alias("sequence"))).alias("authors"),
        F.array(F.struct(F.lit(None).cast("string").alias("publicationDate"), F.lit(None).cast("string").alias("issuePublicationDate"), F.when(k % 5 == 0, F.concat(F.lit("10.1/"), k)).alias("doi")), F.struct(F.when(k % 4 != 0, F.concat((k % 30 + 1990).cast("string"), F.lit("-05-01"))).alias("publicationDate"), F.lit("1989-01-01").alias("issuePublicationDate"), F.lit("10.2/x").alias("doi"))).alias("publications"),
        F.array(F.struct(F.lit("text/plain").alias("mimetype"), F.lit("t").alias("link")), F.struct(F.when(k % 2 == 0, "application/pdf").alias("mimetype"), F.concat(F.lit("p"), k).alias("link"))).alias("downloads"),
    )
    pages = read(s, d, "pages")
    lists = [pages.where(k % n == 0).select(F.lit(f"list{n}").alias("file"), F.lit(f"query {n}").alias("query"), k.cast("int").alias("pos"), rec.alias("rec")) for n in (2, 3)]
    return lists[0].unionByName(lists[1])


def _pages(s, d, size=100):
    """The result lists of :func:`_found_records` as pages of a search service, cached in the shared folder and read through the data source."""
    found = _found_records(s, d).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("pos")) - 1)
    start = (F.floor(F.col("n") / size) * size).cast("int")
    total = found.groupBy("query").agg(F.count("*").alias("total"))
    lists = found.groupBy("query", start.alias("from")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "rec"))), lambda x: x["rec"]).alias("results")).join(total, "query")
    rows = lists.select("query", "from", F.struct("results", F.struct("total").alias("stats")).alias("response"), F.regexp_replace("query", " ", "_").alias("slug"), F.lpad(F.col("from").cast("string"), 6, "0").alias("start"))
    path = f"{shared_folder(rows).rstrip('/')}/pages-{uuid.uuid4().hex}"
    rows.repartition("slug", "start").write.partitionBy("slug", "start").json(path)
    return paged.read_result_pages(s, path)


def _audited(s, d):
    found = _pages(s, d)
    merged = records.merge_pages(found)
    rows = records.flat(merged).withColumnRenamed("pdf_url", "pdf").join(merged.select("id", F.col("rec.stiType").alias("sti_type")), "id")
    files = read(s, d, "pages").where("page_id % 4 = 0").select(F.col("page_id").cast("string").alias("id"), F.length("html").alias("bytes"))
    texts = _docs(s, d).where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), "text")
    return records.source_audit(found.groupBy("query").agg(F.count("*").alias("total")), rows, files, texts, read(s, d, "events").where("event_id % 97 = 0"))


#: Vocabularies by role, and the words that sentences of claims are made of.
ROLES = {
    "outcome": {"spread": "flame spread", "soot": "soot(?: yield)?", "ignition": "ignition|igniting"}, "condition": {"microgravity": "micro-?gravity", "oxygen": "high oxygen|oxygen-rich"},
    "fuel": {"paper": "paper|cellulose", "cotton": "cotton"}, "geometry": {"sheet": "sheets?", "rod": "rods?|cylinders?"}, "species": {"co": "CO", "water": "water vapou?r", "soot": "soot"}, "countermeasure": {"co2": "CO2", "mist": "water mist"},
}
IMPLIED = {"ignition": {"could not ignite": "decrease"}}
_PARTS = (
    ("", "Previous studies aside, ", "In microgravity ", "As in high oxygen and microgravity, ", "Under oxygen-rich conditions "), ("the flame spread", "the soot yield", "soot and ignition, then ignition again,", "the colour of the flame"),
    (" increased", " was reduced by much", " did not change", " grew and declined", " stayed, as it could not ignite,", " was as expected", " was faster, higher and lower"), (" over paper", " over thin cotton sheets", " on rods of paper", "", " around non-paper cylinders"),
    (".", " with CO2.", " as CO2 suppressed it.", " though water mist did not prevent it, with CO and water vapor.", " while soot and CO were measured in all of the runs that were made."),
)


def _told_claims(s, d):
    """(doc, pos, kind, sentence): a sentence for each line of an order, made from the line's keys; and the reports' profiles."""
    line = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    k = F.col("l_partkey") + F.col("l_suppkey") * 7 + F.col("l_linenumber")
    words = [F.element_at(F.array(*map(F.lit, p)), (F.floor(k / n) % len(p) + 1).cast("int")) for p, n in zip(_PARTS, (1, 5, 3, 11, 2), strict=True)]
    kinds = F.array(*map(F.lit, ("ABSTRACT", "RESULTS", "INTRO", "DISCUSS", "CONCL")))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("int")
    sentences = line.select(F.col("l_orderkey").alias("doc"), pos.alias("pos"), F.element_at(kinds, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("kind"), F.concat(*words).alias("sentence"))
    key = F.col("o_orderkey")
    some = lambda n, v: F.when(key % n == 0, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    profiles = read(s, d, "orders").select(key.alias("doc"), some(2, "cotton").alias("fuels"), some(3, "microgravity").alias("conditions"), some(5, "rod").alias("geometries"))
    return sentences, profiles


def _evidence(s, d):
    return X.evidence(*[_told_claims(s, d)[0], ROLES, _told_claims(s, d)[1]], implied=IMPLIED)


def _summarised(s, d):
    k = F.col("doc_id")
    papers = _docs(s, d).select(
        k.alias("doc"), F.concat(F.lit("On "), "source").alias("title"), F.when(k % 3 > 0, F.col("text")).alias("abstract"), F.when(k % 2 == 0, F.array(F.lit("Paper"), F.lit("Cotton"))).alias("fuels"), F.array(F.lit("Low gravity")).alias("conditions"),
        F.when(k % 5 == 0, F.array(F.lit("Drop tower"))).alias("platforms"), F.when(k % 4 == 0, (k % 7).cast("int")).alias("n_tests"), F.when(k % 6 == 0, "5 s").alias("duration"), F.when(k % 7 == 0, F.array(F.lit("BASS"), F.lit("FLEX"))).alias("experiments"),
        F.array().cast("array<string>").alias("missions"), F.when(k % 9 == 0, "21 % O2").alias("atmosphere"),
    )
    quotes = _docs(s, d).select(k.alias("doc"), F.explode(F.sequence(F.lit(1), (k % 4).cast("int") + 1)).alias("rank")).select("doc", "rank", F.concat(F.lit("quote "), "rank").alias("quote")).where("doc % 4 > 0")
    return X.summaries(papers, quotes).select("doc", F.md5(F.col("l1").cast("binary")).alias("l1"), F.array_join("l2", "|").alias("l2"), F.md5(F.col("l3").cast("binary")).alias("l3"))


def _regimes(s, d):
    rows = predict.experiment_rows(*_experiments(s, d), BY_OUTCOME, TYPICAL).withColumn("key", F.concat_ws("|", "finding", "paper", "fuel", "condition", "outcome", "regime")).dropDuplicates(["key"])
    return boosting.accuracy(boosting.cross_validated(rows, ("oxygen", "pressure", "flow"), "regime", "key", ("no_spread", "marginal", "spread"), "fuel", FUELS, trees=40))


def _texts(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("id"), "text")
    return docs.where("id % 3 = 0"), docs.where("id % 2 = 0").withColumn("text", F.concat(F.lit("scan: "), "text"))


_TAKE = W + VOTES + """, p AS (SELECT geometry, paper_id, max(CASE WHEN study_type = 'flight' THEN 1 ELSE 0 END) AS hit FROM claims GROUP BY ALL), b AS (SELECT geometry, sum(hit) / count(*) AS share FROM p GROUP BY geometry HAVING count(*) >= 5),
t AS (SELECT geometry, max(seconds) AS longest FROM claims WHERE seconds IS NOT NULL AND geometry IS NOT NULL GROUP BY geometry HAVING count(*) >= 3)
SELECT geometry, 'bias' AS gap, floor(round(share * 100, 4)) AS value FROM b WHERE share < 0.25 UNION ALL SELECT geometry, 'duration', CAST(longest AS DOUBLE) FROM t WHERE longest < 3600 AND geometry IN (SELECT geometry FROM b)"""
_SUB = "WITH RECURSIVE" + W.removeprefix("WITH") + EDGE_ROWS + """, e AS (SELECT * FROM edges WHERE papers >= 2 AND split_part(src, ':', 1) IN ('condition', 'outcome') AND split_part(dst, ':', 1) IN ('condition', 'outcome')),
x AS (SELECT src AS s, dst AS t FROM e UNION SELECT dst, src FROM e), n1 AS (SELECT 'condition:Brand#11' AS node UNION SELECT t FROM x WHERE s = 'condition:Brand#11'), n2 AS (SELECT node FROM n1 UNION SELECT t FROM x WHERE s IN (SELECT node FROM n1))
SELECT * FROM e WHERE src IN (SELECT node FROM n2) AND dst IN (SELECT node FROM n2) ORDER BY papers DESC, src, rel, dst LIMIT 80"""
_HEADS = {k: " + ".join(f"(list_contains(ws, '{w}'))::INT" for w in p.split("|")) for k, p in PLATFORMS.items()}
_BODY = f"list_transform(list_sort(list_filter([{', '.join(f'''{{'n': -len(list_filter(ws, lambda w: w IN ({_quoted(p.split('|'))}))), 'i': {i}, 'id': '{k}'}}''' for i, (k, p) in enumerate(TERMS.items()))}], lambda x: x.n <= -3)), lambda x: x.id)[1:2]"

QUERIES = {
    "side_rows": (
        lambda s, d: C.side_rows(C.votes(claims(s, d))),
        W + VOTES + f" SELECT {_ID.format('')} AS id, direction, paper_id, study_type, fuel, seconds, year FROM voted QUALIFY count(*) OVER (PARTITION BY condition, outcome, geometry) >= 2",
    ),
    "takeaway_gaps": (lambda s, d: C.gap_items("geometry", V.group_bias(claims(s, d), "geometry", "study_type", "flight", share=0.25), V.duration_gap(claims(s, d), "geometry")), _TAKE),
    "group_mix": (
        lambda s, d: V.group_mix(claims(s, d), "geometry", "study_type"),
        W + """, t AS (SELECT geometry FROM claims WHERE geometry IS NOT NULL GROUP BY geometry HAVING count(DISTINCT paper_id) >= 5), x AS (SELECT geometry AS topic, study_type, paper_id FROM claims JOIN t USING (geometry) UNION ALL SELECT 'overall', study_type, paper_id FROM claims)
        SELECT topic, study_type AS "group", count(DISTINCT paper_id) AS papers FROM x WHERE study_type IS NOT NULL GROUP BY ALL""",
    ),
    "graph_context_edges": (
        lambda s, d: G.context_edges(_context(s, d)),
        W + """, x AS (SELECT paper_id, 'implicated_in' AS rel, 'species:sp' || suppkey % 7 AS src, 'outcome:' || outcome AS dst FROM claims
          UNION ALL SELECT paper_id, 'implicated_in', 'species:sp' || partkey % 11, 'outcome:' || outcome FROM claims WHERE partkey % 3 = 0
          UNION ALL SELECT paper_id, 'hosted', 'platform:pl' || suppkey % 5, 'fuel:' || fuel FROM claims WHERE suppkey % 4 <> 0)
        SELECT src, rel, dst, count(DISTINCT paper_id) AS papers, count(*) AS findings FROM x WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL""",
    ),
    "graph_subgraph": (lambda s, d: G.subgraph(G.edges(claims(s, d)), ("condition", "outcome"), least=2, focus="condition:Brand#11", depth=2, limit=40), _SUB),
    "csv_votes": (
        lambda s, d: export.votes_flattened(
            C.groups(C.votes(claims(s, d))).withColumn("votes", F.map_filter(F.map_from_arrays(F.array(F.lit("increase"), F.lit("decrease"), F.lit("no_change")), F.array("votes_increase", "votes_decrease", "votes_no_change")), lambda k, v: v > 0)),
            s.createDataFrame([("Brand#11", "Elevated"), ("7", "Spread")], "id string, label string"),
        ),
        W + VOTES + GROUPS + """ SELECT id, CASE condition WHEN 'Brand#11' THEN 'Elevated' ELSE condition END AS condition, CASE outcome WHEN '7' THEN 'Spread' ELSE outcome END AS outcome, status, CAST(n_papers AS VARCHAR) AS n_papers,
        CAST(votes_increase AS VARCHAR) AS increase, CAST(votes_decrease AS VARCHAR) AS decrease, CAST(votes_no_change AS VARCHAR) AS no_change, '0' AS mixed FROM grp""",
    ),
    "experiment_rows": (lambda s, d: predict.experiment_rows(*_experiments(s, d), BY_OUTCOME, TYPICAL), W + _EXPERIMENTS),
    "knn_confusion": (
        lambda s, d: predict.confusion(_told(s, d)),
        """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), sd AS (SELECT list(CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS sd FROM (SELECT i, stddev_pop(x) AS s FROM x GROUP BY i)),
        z AS (SELECT vec_id, label, list_transform(list_zip(embedding, sd), lambda p: p[1]::DOUBLE / p[2]) AS v FROM embeddings CROSS JOIN sd),
        n AS (SELECT q.vec_id AS query, q.label AS own, e.vec_id AS id, e.label, sqrt(list_sum(list_transform(list_zip(e.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM z e CROSS JOIN z q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
        k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 25), w AS (SELECT query, own, label, sum(1 / (d + 0.001::DOUBLE)) AS w FROM k GROUP BY ALL), sh AS (SELECT *, round(w / sum(w) OVER (PARTITION BY query), 6) AS share FROM w),
        p AS (SELECT query, own, label AS predicted FROM sh QUALIFY row_number() OVER (PARTITION BY query ORDER BY share DESC, label) = 1) SELECT own AS label, predicted, count(*) AS n FROM p GROUP BY ALL""",
    ),
    "oxygen_predictions": (
        _swept,
        W + """, r AS (SELECT concat_ws('|', paper_id, line, partkey, suppkey, direction) AS id, direction AS label, confidence::DOUBLE * 30 AS oxygen FROM claims), e AS (SELECT greatest(min(oxygen) - 1, 0) AS low, max(oxygen) + 1 AS high FROM r),
        g AS (SELECT CAST(i AS INT) AS i, round(10.0::DOUBLE + i * (30.0::DOUBLE / 25), 6) AS value FROM range(26) t(i)), n AS (SELECT i, id, label, sqrt((oxygen - value) * (oxygen - value)) AS d FROM r CROSS JOIN g),
        k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, id) <= 25), w AS (SELECT i, label, sum(1 / (d + 0.001::DOUBLE)) AS w FROM k GROUP BY ALL), sh AS (SELECT *, round(w / sum(w) OVER (PARTITION BY i), 6) AS share FROM w)
        SELECT i, value, value BETWEEN low AND high AS inside, label AS predicted, share FROM sh JOIN g USING (i) CROSS JOIN e QUALIFY row_number() OVER (PARTITION BY i ORDER BY share DESC, label) = 1""",
    ),
    "class_folds": (
        lambda s, d: predict.folds(_vectors(s, d).select("vec_id", "label"), "label", "vec_id"),
        "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INT) AS fold FROM embeddings",
    ),
    "study_kinds": (
        lambda s, d: _docs(s, d).select("doc_id", X.study_type(X.tags(F.col("text"), PLATFORMS), F.col("text")).alias("kind")),
        f"""WITH w AS (SELECT doc_id, text, {_WS.format('text')} AS ws FROM documents), g AS (SELECT doc_id, regexp_matches(lower(text[1:600]), 'review|survey|overview') AS r, {', '.join(f"({v}) > 0 AS {k}_" for k, v in _HEADS.items())} FROM w)
        SELECT doc_id, CASE WHEN r THEN 'review' WHEN orbital_ AND (short_ OR ground_) THEN 'both' WHEN orbital_ THEN 'flight' WHEN short_ THEN 'short_ug' WHEN model_ AND NOT ground_ THEN 'computational' ELSE 'ground' END AS kind FROM g""",
    ),
    "profile_tags": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.profile(F.substring("text", 1, 80), F.col("text"), TERMS), ",").alias("tags")),
        f"""WITH w AS (SELECT doc_id, {_WS.format('text')} AS ws, {_WS.format('text[1:80]')} AS hs FROM documents), t AS (SELECT doc_id, ({_by_count(TERMS, 'hs')})[1:3] AS head, {_BODY} AS body FROM w)
        SELECT doc_id, array_to_string(CASE WHEN len(head) > 0 THEN head ELSE body END, ',') AS tags FROM t""",
    ),
    "tests_counted": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", X.n_tests(F.concat(F.lit("In "), F.col("o_orderkey") % 90, F.lit(" burning tests and "), F.col("o_orderkey") % 7, F.lit(" drops, 9000 experiments"))).alias("n")),
        "SELECT o_orderkey, nullif(greatest(CASE WHEN o_orderkey % 90 >= 2 THEN o_orderkey % 90 ELSE 0 END, CASE WHEN o_orderkey % 7 >= 2 THEN o_orderkey % 7 ELSE 0 END), 0)::DOUBLE AS n FROM orders",
    ),
    "better_fields": (
        lambda s, d: X.overridden(
            claims(s, d).select((F.col("paper_id") * 10 + F.col("line")).alias("k"), "direction", "effect"),
            claims(s, d).select((F.col("paper_id") * 10 + F.col("line")).alias("k"), F.when(F.col("line") == 1, "decrease").when(F.col("line") == 2, "sideways").alias("direction"), F.when(F.col("line") == 3, "unknown").otherwise("odd").alias("effect")).where("k % 2 = 1").distinct(),
            "k", ("direction", "effect"), BETTER,
        ),
        W + " SELECT paper_id * 10 + line AS k, CASE WHEN line = 1 THEN 'decrease' ELSE direction END AS direction, CASE WHEN line = 3 THEN 'unknown' ELSE effect END AS effect FROM claims",
    ),
    "swapped_entities": (
        lambda s, d: qa.swapped(_turns(s, d), "before", "text", BY_TYPE).select("conv_id", "turn", F.md5(F.col("swapped").cast("binary")).alias("digest")),
        "WITH c AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL), " + _swap_sql("before", "text", "c") + " SELECT conv_id, turn, CASE WHEN hit THEN md5(out) END AS digest FROM s3",
    ),
    "comparison_sides": (
        lambda s, d: read(s, d, "part").select("p_partkey", qa.comparison(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Compare "), "p_name", F.lit(" with "), "p_type", F.lit("?"))).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" vs. "), "p_type")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("What is the difference between "), "p_name", F.lit(" and "), "p_type")).otherwise(F.col("p_name"))).alias("x"))
        .select("p_partkey", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b")),
        "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS a, CASE WHEN p_partkey % 4 < 3 THEN p_type END AS b FROM part",
    ),
    "citation_numbers": (
        lambda s, d: _docs(s, d).select("doc_id", qa.citations(F.concat(F.lit("As ["), F.col("doc_id") % 9, F.lit("] and ["), F.col("doc_id") % 5, F.lit("] and [99999] say")), F.lit(5)).alias("c")).select("doc_id", F.array_join("c.valid", ",").alias("valid"), F.array_join("c.invalid", ",").alias("invalid")),
        """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = doc_id % 5 THEN [doc_id % 9] ELSE [doc_id % 9, doc_id % 5] END AS c FROM documents)
        SELECT doc_id, array_to_string(list_filter(c, lambda x: x BETWEEN 1 AND 5), ',') AS valid, array_to_string(list_filter(c, lambda x: NOT x BETWEEN 1 AND 5), ',') AS invalid FROM c""",
    ),
    "answers_for_readers": (
        lambda s, d: qa.rendered(_answer_rows(s, d)[0], "student", _answer_rows(s, d)[1], GLOSSARY),
        None,
    ),
    "good_blocks": (
        lambda s, d: T.paragraphs(_docs(s, d)).groupBy("doc").agg(F.count_if(T.good_block(F.col("block"))).alias("good"), F.count("*").alias("blocks")),
        r"""WITH b AS (SELECT doc_id AS doc, trim(unnest(string_split(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), chr(10)))) AS block FROM documents)
        SELECT doc, count(*) FILTER (NOT regexp_matches(block, '\.{5,}') AND length(block) >= 40 AND length(regexp_replace(block, '[^\p{L}]', '', 'g')) >= 0.6 * length(regexp_replace(block, '\s', '', 'g'))) AS good, count(*) AS blocks FROM b WHERE block <> '' GROUP BY doc""",
    ),
    "glossary_mentions": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(formatting.mentions(F.regexp_replace("text", "[^A-Za-z]+", " "), ["tion", "than", "und", "les"]), ",").alias("terms")),
        r"""WITH t AS (SELECT doc_id, ' ' || lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || ' ' AS t FROM documents), p AS (SELECT doc_id, unnest(['tion', 'than', 'und', 'les']) AS w, t FROM t),
        a AS (SELECT doc_id, w, least(nullif(instr(t, ' ' || w || ' '), 0), nullif(instr(t, ' ' || w || 's '), 0)) AS place FROM p), g AS (SELECT doc_id, string_agg(w, ',' ORDER BY place) AS terms FROM a WHERE place IS NOT NULL GROUP BY doc_id) SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN g USING (doc_id)""",
    ),
    "names_and_units": (
        lambda s, d: read(s, d, "part").select("p_partkey", dedupe.surname(F.concat("p_type", F.lit(", X."))).alias("surname"), formatting.lower_label(F.concat_ws(" ", F.initcap("p_name"), "p_type")).alias("label"), F.round(predict.to_kpa(F.col("p_size").cast("double"), F.element_at(F.array(F.lit("kPa"), F.lit("psi"), F.lit("atm"), F.lit("bar"), F.lit("torr")), (F.col("p_partkey") % 5 + 1).cast("int"))), 6).alias("kpa")),
        "SELECT p_partkey, lower(p_type) AS surname, lower(p_name) || ' ' || p_type AS label, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 6.89476 WHEN 2 THEN 101.325 WHEN 3 THEN 100 END::DOUBLE, 6) AS kpa FROM part",
    ),
    "records_merged": (
        lambda s, d: records.flat(records.merge_pages(_pages(s, d))),
        """SELECT CAST(page_id AS VARCHAR) AS id, 'A title of ' || url AS title, CAST(CASE WHEN page_id % 4 <> 0 THEN page_id % 30 + 1990 ELSE 1989 END AS INT) AS year, 'Doe, J.; Roe, R.' AS authors, CASE WHEN page_id % 3 = 0 THEN 'about ' || page_id END AS abstract, 'C' AS center,
        CASE WHEN page_id % 2 = 0 THEN 'p' || page_id END AS pdf_url, CASE WHEN page_id % 5 = 0 THEN '10.1/' || page_id ELSE '10.2/x' END AS doi, concat_ws('; ', CASE WHEN page_id % 2 = 0 THEN 'query 2' END, CASE WHEN page_id % 3 = 0 THEN 'query 3' END) AS queries FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0""",
    ),
    "records_audited": (
        lambda s, d: records.audit_measures(records.flat(records.merge_pages(_found_records(s, d))).withColumnRenamed("pdf_url", "pdf"), _docs(s, d).select(F.col("doc_id").cast("string").alias("id"), "text").where("id % 3 = 0")),
        """WITH p AS (SELECT page_id AS k, page_id % 2 = 0 AS pdf, page_id % 3 = 0 AS abstract FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0), t AS (SELECT doc_id AS k, trim(text, ' ') AS t FROM documents WHERE doc_id % 3 = 0)
        SELECT 'records' AS measure, count(*) AS n FROM p UNION ALL SELECT 'with_pdf', count(*) FILTER (pdf) FROM p UNION ALL SELECT 'without_pdf', count(*) FILTER (NOT pdf) FROM p UNION ALL SELECT 'without_pdf_and_abstract', count(*) FILTER (NOT pdf AND NOT abstract) FROM p
        UNION ALL SELECT 'without_abstract', count(*) FILTER (NOT abstract) FROM p UNION ALL SELECT 'without_year', 0 UNION ALL SELECT 'texts', count(t) FROM t UNION ALL SELECT 'short_texts', count(*) FILTER (length(t) < 200) FROM t UNION ALL SELECT 'text_chars', CAST(sum(length(t)) AS BIGINT) FROM t
        UNION ALL SELECT 'not_extracted', count(*) FROM p WHERE pdf AND k NOT IN (SELECT k FROM t WHERE t IS NOT NULL)""",
    ),
    "texts_with_fallback": (
        lambda s, d: records.with_fallback_text(_docs(s, d).select(F.col("doc_id").alias("id"), "lang"), *_texts(s, d)).select("id", "lang", F.md5(F.col("full_text").cast("binary")).alias("digest")),
        "SELECT doc_id AS id, lang, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN md5(text) WHEN doc_id % 2 = 0 THEN md5('scan: ' || text) END AS digest FROM documents",
    ),
    "pending_papers": (lambda s, d: records.pending(_docs(s, d).select(F.col("doc_id").alias("id")), _texts(s, d)[0].select("id")), "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0"),
    "findings_full": (_evidence, None),
    "report_summaries": (
        _summarised,
        r"""WITH p AS (SELECT doc_id AS doc, 'On ' || source AS title, CASE WHEN doc_id % 3 > 0 THEN text END AS abstract FROM documents),
        x AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(coalesce(abstract, ''), '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda t: length(t) > 30) AS st FROM p),
        y AS (SELECT *, list_filter(st, lambda t: regexp_matches(t, '(?i)\b(?:suggest|indicate|conclu|demonstrat|show|reveal)\w*')) AS cs FROM x)
        SELECT doc, md5(coalesce(cs[-1], st[-1], title)) AS l1, 'Studied: ' || CASE WHEN doc % 2 = 0 THEN 'Paper, Cotton' ELSE 'n/a' END || ' · Low gravity|Platform: ' || CASE WHEN doc % 5 = 0 THEN 'Drop tower' ELSE 'n/a' END
          || coalesce(' · ' || nullif(concat_ws(' · ', CASE WHEN doc % 4 = 0 AND doc % 7 > 0 THEN doc % 7 || ' tests' END, CASE WHEN doc % 6 = 0 THEN '5 s freefall' END, CASE WHEN doc % 7 = 0 THEN 'BASS, FLEX' END, CASE WHEN doc % 9 = 0 THEN '21 % O2' END), ''), '') || CASE WHEN doc % 4 > 0 THEN '|quote 1|quote 2' ELSE '' END AS l2,
          md5(CASE WHEN length(abstract) > 0 THEN abstract ELSE title END) AS l3 FROM y""".replace("\\u00b7", "·"),
    ),
    "regime_boosting": (_regimes, None),
    "source_profile": (
        _audited,
        """WITH r AS (SELECT page_id AS k, page_id % 2 = 0 AS pdf, page_id % 3 = 0 AS abstract, CASE WHEN page_id % 4 <> 0 THEN page_id % 30 + 1990 ELSE 1989 END AS year FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0),
        f AS (SELECT page_id AS k, length(html) AS bytes FROM pages WHERE page_id % 4 = 0), t AS (SELECT trim(text, ' ') AS t FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL),
        a AS (SELECT 'records' AS measure, 'all' AS key, count(*) AS n FROM r UNION ALL SELECT 'with_pdf', 'all', count(*) FILTER (pdf) FROM r UNION ALL SELECT 'without_pdf', 'all', count(*) FILTER (NOT pdf) FROM r UNION ALL SELECT 'without_pdf_and_abstract', 'all', count(*) FILTER (NOT pdf AND NOT abstract) FROM r
          UNION ALL SELECT 'without_abstract', 'all', count(*) FILTER (NOT abstract) FROM r UNION ALL SELECT 'without_year', 'all', 0 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM r GROUP BY year UNION ALL SELECT 'decade', year // 10 || '0s', count(*) FROM r GROUP BY year // 10
          UNION ALL SELECT 'type', 'report', count(*) FROM r HAVING count(*) > 0 UNION ALL SELECT 'center', 'C', count(*) FROM r HAVING count(*) > 0 UNION ALL SELECT 'hits', 'query 2', count(*) FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'hits', 'query 3', count(*) FROM pages WHERE page_id % 3 = 0
          UNION ALL SELECT 'fetched', 'all', count(*) FROM f UNION ALL SELECT 'fetched_bytes', 'all', CAST(sum(bytes) AS BIGINT) FROM f UNION ALL SELECT 'not_fetched', 'all', count(*) FROM r WHERE pdf AND k NOT IN (SELECT k FROM f) UNION ALL SELECT 'failures', 'all', count(*) FROM events WHERE event_id % 97 = 0
          UNION ALL SELECT 'texts', 'all', count(*) FROM t UNION ALL SELECT 'short_texts', 'all', count(*) FILTER (length(t) < 200) FROM t UNION ALL SELECT 'text_chars', 'all', CAST(sum(length(t)) AS BIGINT) FROM t)
        SELECT * FROM a""",
    ),
}
