"""Queries of cards, lists, comparisons and missions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.functions.lineage import cut
from evidex.operators import cards as K
from evidex.operators import consensus as C
from evidex.operators import graph as G
from evidex.operators import mission as M
from evidex.operators import risk as R
from evidex.plans.claims import by_paper, claims, read
from evidex.plans.evidence_queries import _BRIEF, EDGE_ROWS, GROUPS, MISSION_RISKS, PROFILES, RISK_SQL, RISKS, VOTES, W, _cabins, _found, _profiles, _values

ROLES = ("condition", "outcome", "geometry", "fuel", "countermeasure")
_ROLE_ROWS = " UNION ALL ".join(f"SELECT paper_id, '{r}' AS role, {r} AS value FROM claims" for r in ROLES)
_NODES = f", nodes AS (SELECT role || ':' || value AS node, count(DISTINCT paper_id) AS papers FROM ({_ROLE_ROWS}) WHERE value IS NOT NULL GROUP BY ALL)"
#: Sets of two to four reports with neighbouring ids.
_SETS = ", sets AS (SELECT paper_id // 3 AS set, paper_id FROM (SELECT DISTINCT paper_id FROM claims) QUALIFY count(*) OVER (PARTITION BY paper_id // 3) BETWEEN 2 AND 4), sizes AS (SELECT set, count(*) AS size FROM sets GROUP BY set)"
#: One question per brand and segment; its reports are those whose id leaves the same remainder.
_ASKED = """, pairs AS (SELECT condition, geometry, row_number() OVER (ORDER BY condition, geometry) AS query FROM (SELECT DISTINCT condition, geometry FROM claims)),
asked AS (SELECT CAST(query AS INT) AS query, condition AS entity FROM pairs UNION ALL SELECT CAST(query AS INT), geometry FROM pairs),
retrieved AS (SELECT DISTINCT CAST(paper_id % 200 AS INT) AS query, paper_id FROM claims)"""
_ORDER = "status = 'contradictory' DESC, n_papers DESC, id"
_PROFILE_ROWS = ", ".join(f"('{m}', {a}, {b}, {c}, {e}, {f})" for m, a, b, c, e, f in PROFILES)
_PROFILE_SQL = f", profiles(mission, days, mg, pg, o2, kpa) AS (VALUES {_PROFILE_ROWS}), mrisks(risk, severity, scaled, conditions, outcomes, geometries) AS (VALUES {_values(MISSION_RISKS)})"


def _edges(s, d):
    return G.edges(by_paper(s, d))


def _groups(s, d):
    return C.groups(C.votes(claims(s, d)))


def _nodes(s, d):
    return G.nodes(claims(s, d), ROLES).select("node", "papers")


def _sets(s, d):
    every = claims(s, d).select(F.floor(F.col("paper_id") / 3).alias("set"), "paper_id").distinct()
    fit = every.groupBy("set").count().where("count between 2 and 4").select("set")
    return every.join(fit, "set")


def _questions(s, d):
    """One question for each brand and segment, numbered in their order: twenty-five by five."""
    pairs = claims(s, d).select("condition", "geometry").distinct().withColumn("query", F.dense_rank().over(Window.orderBy("condition", "geometry")))
    return pairs.select("query", F.explode(F.array("condition", "geometry")).alias("entity"))


def _retrieved(s, d):
    return claims(s, d).select((F.col("paper_id") % 200).cast("int").alias("query"), "paper_id").distinct()


def _members(s, d):
    return _nodes(s, d).select((F.length("node") % 7).alias("community"), "node", F.substring_index("node", ":", 1).alias("type"), F.col("papers").alias("score"))


def _ranked_members(s, d):
    """Concepts with their community of greatest modularity and their rank."""
    links = cut(G.undirected(_edges(s, d)))
    return G.modularity_communities(links).join(G.pagerank(links), "node").select("community", "node", F.substring_index("node", ":", 1).alias("type"), F.col("rank").alias("score"))


def _built(s, d):
    """Orders as reports of a build."""
    k = F.col("o_orderkey")
    return read(s, d, "orders").select(
        k.alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("study_type"), (k % 3 == 0).alias("full_text"), F.when(k % 11 == 0, k - 1).alias("duplicate_of"), F.when(k % 4 > 0, k % 4).alias("n_tests"),
        F.when(k % 5 == 0, F.array(F.lit("STS-1"))).alias("missions"), F.when(k % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("experiments"), F.when(k % 2 == 0, "llm").otherwise("rules").alias("method"),
    )


def _quotes(s, d):
    return read(s, d, "lineitem").select((F.col("l_returnflag") != "N").alias("ok"))


def _mission_evidence(s, d):
    """What is known of the risks, in the form that missions need; conditions that are covered follow from the number of reports."""
    defined = R.definitions(s, MISSION_RISKS).select("risk", "conditions")
    gaps = K.risk_gaps(_found(s, d)).groupBy("risk").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    covered = F.when(F.col("n_papers") % 2 == 0, F.array(F.lit("elevated_o2"))).otherwise(F.array(F.lit("partial_gravity")))
    return _found(s, d).join(gaps, "risk", "left").join(defined, "risk").select("risk", "n_papers", "strength", "n_material", "n_flight", "longest", F.coalesce("gaps", F.array().cast("array<string>")).alias("gaps"), "conditions", covered.alias("covered"), (F.col("n_papers") % 2 == 1).alias("partial"), F.col("n_material").alias("effective"))


_EVIDENCE = RISK_SQL + _PROFILE_SQL + """, known AS (SELECT f.*, m.conditions, CASE WHEN n_papers % 2 = 0 THEN ['elevated_o2'] ELSE ['partial_gravity'] END AS covered, n_papers % 2 = 1 AS partial,
  list_sort(list_filter([CASE WHEN n_material < 3 THEN 'fewer than three reports on the target material' END, CASE WHEN n_flight < greatest(2, n_papers // 4) THEN 'few flight reports' END, CASE WHEN coalesce(longest, 0) < 3600 THEN 'no burn of an hour or more' END], lambda x: x IS NOT NULL)) AS gaps
  FROM found f JOIN mrisks m USING (risk))"""



QUERIES = {
    "central_nodes": (lambda s, d: K.central(_nodes(s, d), "papers"), W + _NODES + " SELECT node, papers FROM nodes ORDER BY papers DESC, node LIMIT 20"),
    "node_neighbours": (
        lambda s, d: K.neighbours(_edges(s, d)),
        W + EDGE_ROWS + """, b AS (SELECT src AS node, dst AS other, rel, papers, majority, true AS outgoing FROM edges UNION ALL SELECT dst, src, rel, papers, majority, false FROM edges)
        SELECT node, row_number() OVER (PARTITION BY node ORDER BY papers DESC, other, rel, outgoing) AS rank, other, rel, papers, majority, outgoing FROM b QUALIFY rank <= 30""",
    ),
    "node_papers": (
        lambda s, d: K.node_papers(by_paper(s, d)),
        W + EDGE_ROWS + """, n AS (SELECT DISTINCT paper_id, node FROM (SELECT paper_id, src AS node FROM edge_rows UNION ALL SELECT paper_id, dst FROM edge_rows)), y AS (SELECT paper_id, max(year) AS year FROM claims GROUP BY paper_id)
        SELECT node, row_number() OVER (PARTITION BY node ORDER BY coalesce(year, 0) DESC, paper_id) AS rank, paper_id, year FROM n JOIN y USING (paper_id) QUALIFY rank <= 25""",
    ),
    "node_groups": (
        lambda s, d: K.node_groups(_groups(s, d)),
        W + VOTES + GROUPS + f""", e AS (SELECT id, status, n_papers, 'condition:' || condition AS node FROM grp UNION ALL SELECT id, status, n_papers, 'outcome:' || outcome FROM grp UNION ALL SELECT id, status, n_papers, 'geometry:' || geometry FROM grp)
        SELECT node, row_number() OVER (PARTITION BY node ORDER BY {_ORDER}) AS rank, id FROM e WHERE node IS NOT NULL QUALIFY rank <= 8""",
    ),
    "edge_papers": (
        lambda s, d: K.edge_papers(by_paper(s, d)).select("src", "rel", "dst", "rank", "paper_id"),
        W + EDGE_ROWS + " SELECT src, rel, dst, row_number() OVER (PARTITION BY src, rel, dst ORDER BY paper_id) AS rank, paper_id FROM (SELECT DISTINCT src, rel, dst, paper_id FROM edge_rows) QUALIFY rank <= 30",
    ),
    "consensus_list": (
        lambda s, d: K.listed(_groups(s, d), ("contradictory", "consensus")).select("id", "status", "n_papers", "majority"),
        W + VOTES + GROUPS + f" SELECT id, status, n_papers, majority FROM grp WHERE status IN ('contradictory', 'consensus') ORDER BY {_ORDER}",
    ),
    "status_counts": (
        lambda s, d: K.status_counts(_groups(s, d), "brand#1"),
        W + VOTES + GROUPS + " SELECT status, count(*) AS n FROM grp WHERE contains(lower(id), 'brand#1') GROUP BY status",
    ),
    "topic_counts": (
        lambda s, d: K.topics(claims(s, d)),
        W + " SELECT geometry AS topic, count(DISTINCT paper_id) AS n_papers, count(*) AS n_findings, min(year) AS first_year, max(year) AS last_year FROM claims WHERE geometry IS NOT NULL GROUP BY geometry",
    ),
    "topic_papers": (
        lambda s, d: K.topic_papers(claims(s, d)).select("topic", "rank", "paper_id", "findings"),
        W + " SELECT geometry AS topic, row_number() OVER (PARTITION BY geometry ORDER BY count(*) DESC, paper_id) AS rank, paper_id, count(*) AS findings FROM claims WHERE geometry IS NOT NULL GROUP BY geometry, paper_id QUALIFY rank <= 12",
    ),
    "topic_years": (
        lambda s, d: K.topic_years(claims(s, d)),
        W + " SELECT geometry AS topic, year, count(DISTINCT paper_id) AS papers FROM claims WHERE geometry IS NOT NULL AND year IS NOT NULL GROUP BY ALL",
    ),
    "compare_shared": (
        lambda s, d: K.shared(by_paper(s, d), _sets(s, d)),
        W + _SETS + f" SELECT set, role, value FROM (SELECT paper_id, role, value FROM ({_ROLE_ROWS}) WHERE value IS NOT NULL) JOIN sets USING (paper_id) JOIN sizes USING (set) GROUP BY set, role, value, size HAVING count(DISTINCT paper_id) = size",
    ),
    "compare_agreement": (
        lambda s, d: K.agreement(claims(s, d).withColumn("outcome", (F.col("outcome").cast("int") % 2).cast("string")).withColumn("condition", F.substring("condition", 1, 6)), _sets(s, d), "line", "partkey", "suppkey", "confidence", "seconds", "direction"),
        W + _SETS + """, last AS (SELECT set, condition, outcome, paper_id, direction FROM (SELECT paper_id, substr(condition, 1, 6) AS condition, CAST(CAST(outcome AS INT) % 2 AS VARCHAR) AS outcome, direction, line, partkey, suppkey, confidence, seconds FROM claims) JOIN sets USING (paper_id)
          QUALIFY row_number() OVER (PARTITION BY set, condition, outcome, paper_id ORDER BY line DESC, partkey DESC, suppkey DESC, confidence DESC, seconds DESC, direction DESC) = 1)
        SELECT set, condition, outcome, array_to_string(list_sort(list(DISTINCT direction)), ',') AS directions, count(DISTINCT direction) = 1 AS agree FROM last JOIN sizes USING (set) GROUP BY set, condition, outcome, size HAVING count(*) = size""",
    ),
    "paper_cards": (
        lambda s, d: K.paper_cards(claims(s, d)),
        W + " SELECT paper_id, max(year) AS year, count(*) AS findings, " + ", ".join(f"array_to_string(list_sort(list(DISTINCT {c}))[1:3], '; ') AS {c}s" for c in ("study_type", "condition", "fuel")) + " FROM claims GROUP BY paper_id",
    ),
    "entities_with_counts": (
        lambda s, d: K.with_counts(read(s, d, "part").select(F.concat(F.lit("condition:"), "p_brand").alias("node")).distinct().unionByName(s.createDataFrame([("condition:Brand#00",)], "node string")), _nodes(s, d)),
        W + _NODES + " SELECT node, coalesce(papers, 0) AS papers FROM (SELECT DISTINCT 'condition:' || p_brand AS node FROM part UNION ALL SELECT 'condition:Brand#00') LEFT JOIN nodes USING (node)",
    ),
    "top_per_type": (
        lambda s, d: K.top_per_type(_nodes(s, d)),
        W + _NODES + " SELECT split_part(node, ':', 1) AS type, row_number() OVER (PARTITION BY split_part(node, ':', 1) ORDER BY papers DESC, node) AS rank, node, papers FROM nodes QUALIFY rank <= 8",
    ),
    "theme_labels": (
        lambda s, d: K.themes(_members(s, d)),
        W + _NODES + """, m AS (SELECT length(node) % 7 AS community, node, split_part(node, ':', 1) IN ('condition', 'fuel') AS side, papers FROM nodes),
        r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY side, papers DESC, node) AS k, bool_and(side) OVER (PARTITION BY community) AS core FROM m)
        SELECT community, count(*) AS size, string_agg(node, ' & ' ORDER BY k) FILTER (k <= 2 AND side = core) AS label FROM r GROUP BY community HAVING count(*) >= 3""",
    ),
    "corpus_stats": (
        lambda s, d: K.corpus_stats(claims(s, d)),
        W + " SELECT 'findings' AS measure, count(*) AS value FROM claims UNION ALL SELECT 'papers', count(DISTINCT paper_id) FROM claims UNION ALL SELECT 'first_year', min(year) FROM claims UNION ALL SELECT 'last_year', max(year) FROM claims"
        + "".join(f" UNION ALL SELECT '{r}s', count(DISTINCT {r}) FROM claims" for r in ROLES) + " UNION ALL SELECT 'study:' || study_type, count(DISTINCT paper_id) FROM claims GROUP BY study_type",
    ),
    "related_findings": (
        lambda s, d: K.related_findings(claims(s, d), _questions(s, d), _retrieved(s, d)).select("query", "rank", "score"),
        W + _ASKED + """, f AS (SELECT row_number() OVER () AS finding, * FROM claims),
        e AS (SELECT DISTINCT finding, paper_id, confidence, unnest([condition, outcome, geometry, fuel, countermeasure]) AS entity FROM f),
        h AS (SELECT query, finding, paper_id, confidence, count(*) AS hits FROM e JOIN asked USING (entity) GROUP BY ALL),
        s AS (SELECT h.query, round(hits + CAST(confidence AS DOUBLE) + CASE WHEN r.paper_id IS NULL THEN 0 ELSE 0.5::DOUBLE END, 6) AS score FROM h LEFT JOIN retrieved r ON r.query = h.query AND r.paper_id = h.paper_id WHERE hits >= 2 OR r.paper_id IS NOT NULL)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC) AS rank, score FROM s QUALIFY rank <= 12""",
    ),
    "evidence_panel": (
        lambda s, d: K.evidence_panel(_groups(s, d), _questions(s, d)),
        W + VOTES + GROUPS + _ASKED + """, e AS (SELECT DISTINCT id, status, n_papers, unnest([condition, outcome, geometry]) AS entity FROM grp), need AS (SELECT query, least(count(*), 2) AS need FROM asked GROUP BY query),
        h AS (SELECT query, id, status, n_papers FROM e JOIN asked USING (entity) JOIN need USING (query) GROUP BY query, id, status, n_papers, need HAVING count(*) >= need)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY n_papers DESC, id) AS rank, id, status, n_papers FROM h QUALIFY rank <= 4""",
    ),
    "risk_contradictions": (
        lambda s, d: K.risk_contradictions(_groups(s, d), R.definitions(s, RISKS)),
        W + VOTES + GROUPS + f""", rk(risk, severity, scaled, conditions, outcomes, geometries) AS (VALUES {_values(RISKS)})
        SELECT risk, row_number() OVER (PARTITION BY risk ORDER BY {_ORDER}) AS rank, id FROM grp JOIN rk ON list_contains(conditions, condition) AND (list_contains(outcomes, outcome) OR list_contains(geometries, geometry)) WHERE status = 'contradictory' QUALIFY rank <= 6""",
    ),
    "risk_gaps": (lambda s, d: K.risk_gaps(_found(s, d)), W + _EVIDENCE + " SELECT risk, unnest(gaps) AS gap FROM known"),
    "mission_gaps": (
        lambda s, d: M.gaps(_profiles(s), _mission_evidence(s, d)).select("mission", "risk", F.array_join("gaps", "; ").alias("gaps")),
        W + _EVIDENCE + """ SELECT mission, risk, array_to_string(list_concat(gaps, list_filter([CASE WHEN pg > 0 AND list_contains(conditions, 'partial_gravity') AND NOT list_contains(covered, 'partial_gravity') THEN 'partial gravity is not measured' END,
        CASE WHEN o2 > 24 AND list_contains(conditions, 'elevated_o2') AND NOT list_contains(covered, 'elevated_o2') THEN 'elevated oxygen is not measured' END, CASE WHEN coalesce(longest, 0) < 3600 THEN 'no long burn in orbit' END], lambda x: x IS NOT NULL)), '; ') AS gaps FROM profiles CROSS JOIN known""",
    ),
    "mission_readiness": (
        lambda s, d: M.readiness(_profiles(s), _mission_evidence(s, d)),
        W + _EVIDENCE + """, l AS (SELECT mission, risk, (n_papers >= 10 AND strength >= 0.5)::INT + (n_material >= 3 AND n_flight >= 3)::INT + (coalesce(longest, 0) >= 3600)::INT + (partial OR pg = 0)::INT + (n_material > 0)::INT AS level FROM profiles CROSS JOIN known)
        SELECT mission, risk, level, ['not ready', 'early', 'early', 'partial', 'partial', 'ready'][level + 1] AS label FROM l""",
    ),
    "mission_summary": (
        lambda s, d: M.narrative(R.briefing(_profiles(s), R.definitions(s, MISSION_RISKS), _found(s, d)).join(_found(s, d).select("risk", "n_material"), "risk")),
        W + RISK_SQL + _BRIEF.rpartition("SELECT mission, risk, relevance")[0] + """, p AS (SELECT b.*, CASE WHEN priority >= 0.45 THEN 'high' ELSE 'other' END AS tier FROM brief b),
        l AS (SELECT mission, list(risk ORDER BY priority DESC, risk) FILTER (tier = 'high') AS high, list(risk ORDER BY priority DESC, risk) AS every, list(risk ORDER BY priority DESC, risk) FILTER (relevance >= 0.3 AND n_material < 3) AS thin FROM p GROUP BY mission)
        SELECT mission, array_to_string(CASE WHEN high IS NULL THEN every[1:2] ELSE high[1:3] END, ', ') AS top, coalesce(array_to_string(thin[1:3], ', '), '') AS thin FROM l""",
    ),
    "invalid_profiles": (
        lambda s, d: M.invalid_fields(_cabins(s, d)),
        "WITH p AS (SELECT 'part ' || p_partkey AS mission, p_partkey * 7 % 3500 - 40 AS a, p_partkey * 11 % 3500 - 40 AS b, p_partkey * 13 % 3500 - 40 AS c, 10 + p_size AS o2, 20 + p_partkey % 120 AS kpa FROM part) "
        + " UNION ALL ".join(f"SELECT mission, '{f}' AS field, {c}::DOUBLE AS value FROM p WHERE {c} NOT BETWEEN {M.BOUNDS[f][0]} AND {M.BOUNDS[f][1]}" for f, c in zip(M.BOUNDS, ("a", "b", "c", "o2", "kpa"), strict=True)),
    ),
    "community_themes": (lambda s, d: K.themes(_ranked_members(s, d)), None),
    "build_stats": (
        lambda s, d: K.build_stats(_built(s, d), claims(s, d), _groups(s, d), {"nodes": _nodes(s, d), "edges": _edges(s, d)}, _quotes(s, d)),
        W + VOTES + GROUPS + EDGE_ROWS + _NODES + """, b AS (SELECT o_orderkey AS k, year(o_orderdate) AS year, o_orderpriority AS kind FROM orders), r AS (SELECT 'report' AS x),
        t AS (SELECT 'papers' AS measure, count(*) AS value FROM b UNION ALL SELECT 'first_year', min(year) FROM b UNION ALL SELECT 'last_year', max(year) FROM b UNION ALL SELECT 'full_text', count(*) FILTER (k % 3 = 0) FROM b
          UNION ALL SELECT 'duplicates', count(*) FILTER (k % 11 = 0) FROM b UNION ALL SELECT 'with_n_tests', count(*) FILTER (k % 4 > 0) FROM b UNION ALL SELECT 'with_mission', count(*) FILTER (k % 5 = 0) FROM b UNION ALL SELECT 'experiment_linked', count(*) FILTER (k % 7 = 0) FROM b
          UNION ALL SELECT 'llm_papers', count(*) FILTER (k % 2 = 0) FROM b UNION ALL SELECT 'study:' || kind, count(*) FROM b GROUP BY kind UNION ALL SELECT 'contradictions', count(*) FILTER (status = 'contradictory') FROM grp UNION ALL SELECT 'consensus', count(*) FILTER (status = 'consensus') FROM grp
          UNION ALL SELECT 'quotes', count(*) FROM lineitem UNION ALL SELECT 'quotes_ok', count(*) FILTER (l_returnflag <> 'N') FROM lineitem UNION ALL SELECT 'findings', count(*) FROM claims UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges)
        SELECT * FROM t""",
    ),
}
