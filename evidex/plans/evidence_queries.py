"""Queries over the claims table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions.lineage import cut
from evidex.operators import consensus as C
from evidex.operators import coverage as V
from evidex.operators import discovery as D
from evidex.operators import graph as G
from evidex.operators import predict as P
from evidex.operators import risk as R
from evidex.plans.claims import CLAIMS_SQL, by_paper, claims, read

W = f"WITH {CLAIMS_SQL}"
VOTES = """, voted AS (
  SELECT * FROM claims WHERE direction IN ('increase', 'decrease', 'no_change')
  QUALIFY row_number() OVER (PARTITION BY condition, outcome, geometry, paper_id ORDER BY confidence DESC, direction, w DESC, fuel, seconds) = 1)"""
_ID = "concat_ws('|', coalesce({0}condition, 'None'), coalesce({0}outcome, 'None'), coalesce({0}geometry, 'None'))"
GROUPS = f""", dirs AS (SELECT condition, outcome, geometry, direction, count(*) AS n, sum(w) AS w FROM voted GROUP BY ALL),
tops AS (SELECT * FROM dirs QUALIFY row_number() OVER (PARTITION BY condition, outcome, geometry ORDER BY w DESC, CASE direction WHEN 'increase' THEN 3 WHEN 'decrease' THEN 2 ELSE 1 END DESC) = 1),
rolled AS (SELECT condition, outcome, geometry, sum(n) AS n_papers, sum(w) AS total,
  sum(CASE WHEN direction = 'increase' THEN n ELSE 0 END) AS votes_increase, sum(CASE WHEN direction = 'decrease' THEN n ELSE 0 END) AS votes_decrease,
  sum(CASE WHEN direction = 'no_change' THEN n ELSE 0 END) AS votes_no_change FROM dirs GROUP BY ALL),
scored AS (SELECT r.*, t.direction AS majority, t.n AS top_n, CAST(t.w AS DOUBLE) / CAST(r.total AS DOUBLE) AS a, 1 - exp(-CAST(r.total AS DOUBLE) / 3.0) AS s
  FROM rolled r JOIN tops t USING (condition, outcome, geometry) WHERE n_papers >= 2),
grp AS (SELECT {_ID.format('')} AS id, condition, outcome, geometry, CAST(n_papers AS BIGINT) AS n_papers, majority, round(a, 6) AS agreement, CAST(n_papers - top_n AS BIGINT) AS minority,
  CASE WHEN a >= 0.8 AND n_papers >= 3 THEN 'consensus' WHEN n_papers - top_n >= 2 AND a < 0.75 THEN 'contradictory' ELSE 'emerging' END AS status,
  round(s, 6) AS strength, CASE WHEN s >= 0.75 THEN 'strong' WHEN s >= 0.45 THEN 'moderate' WHEN s > 0 THEN 'limited' ELSE 'none' END AS label,
  CAST(votes_increase AS BIGINT) AS votes_increase, CAST(votes_decrease AS BIGINT) AS votes_decrease, CAST(votes_no_change AS BIGINT) AS votes_no_change FROM scored)"""
CELLS = """, cells AS (SELECT fuel AS row, condition AS col, count(DISTINCT paper_id) AS papers, count(DISTINCT CASE WHEN study_type IN ('flight', 'both') THEN paper_id END) AS flight FROM claims GROUP BY ALL)"""
SPARSE = """, cells AS (SELECT CAST(suppkey AS VARCHAR) AS row, CAST(partkey % 97 AS VARCHAR) AS col, count(DISTINCT paper_id) AS papers, count(DISTINCT CASE WHEN study_type IN ('flight', 'both') THEN paper_id END) AS flight FROM claims GROUP BY ALL)"""
SERIES = """, series AS (SELECT condition AS label, year, count(DISTINCT paper_id) AS papers FROM claims WHERE year IS NOT NULL GROUP BY ALL)"""
EDGE_ROWS = """, edge_rows AS (SELECT paper_id, direction, w, rel, src, dst FROM (
  SELECT paper_id, direction, w, 'affects' AS rel, 'condition:' || condition AS src, 'outcome:' || outcome AS dst FROM claims
  UNION ALL SELECT paper_id, direction, w, 'burned_in', 'fuel:' || fuel, 'condition:' || condition FROM claims
  UNION ALL SELECT paper_id, direction, w, 'observed_in', 'outcome:' || outcome, 'geometry:' || geometry FROM claims
  UNION ALL SELECT paper_id, direction, w, CASE WHEN effect = 'ineffective' THEN 'fails_to_mitigate' ELSE 'mitigates' END, 'countermeasure:' || countermeasure, 'outcome:' || outcome FROM claims)
  WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
counted AS (SELECT src, rel, dst, count(DISTINCT paper_id) AS papers, count(*) AS findings, sum(w) AS total,
  sum(CASE WHEN direction = 'increase' THEN 1 ELSE 0 END) AS increase, sum(CASE WHEN direction = 'decrease' THEN 1 ELSE 0 END) AS decrease, sum(CASE WHEN direction = 'no_change' THEN 1 ELSE 0 END) AS no_change FROM edge_rows GROUP BY ALL),
edges AS (SELECT src, rel, dst, papers, findings, CAST(increase AS BIGINT) AS increase, CAST(decrease AS BIGINT) AS decrease, CAST(no_change AS BIGINT) AS no_change,
  CASE WHEN increase = greatest(increase, decrease, no_change) THEN 'increase' WHEN decrease = greatest(increase, decrease, no_change) THEN 'decrease' ELSE 'no_change' END AS majority,
  round(greatest(increase, decrease, no_change) / findings, 6) AS agreement, round(1 - exp(-CAST(total AS DOUBLE) / 3.0), 6) AS strength FROM counted),
links AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(papers) AS BIGINT) AS weight FROM edges GROUP BY ALL),
nbr AS (SELECT a AS s, b AS t, weight FROM links UNION ALL SELECT b, a, weight FROM links)"""

#: A short fixed list of risks over the roles of the claims: (risk, severity, grows with time, conditions, outcomes, geometries).
RISKS = [
    ("spread", 5, False, ["Brand#11", "Brand#12", "Brand#21"], ["1", "2", "3"], ["BUILDING"]),
    ("detection", 4, True, ["Brand#13", "Brand#22"], ["10", "11"], ["AUTOMOBILE", "MACHINERY"]),
    ("post_fire", 3, True, ["Brand#31", "Brand#32"], ["20", "30", "40", "50"], []),
    ("ignition", 4, False, ["Brand#41", "Brand#42", "Brand#43", "Brand#44"], ["5"], ["HOUSEHOLD"]),
]
PROFILES = [("station", 180, 180, 0, 21.0, 101.3), ("surface", 45, 12, 33, 34.0, 56.5), ("transit", 1000, 500, 500, 30.0, 70.3)]
#: Conditions of the missions, for risks of their own.
MISSION_RISKS = [
    ("spread", 5, False, ["microgravity", "elevated_o2"], [], []), ("detection", 4, True, ["microgravity"], [], []),
    ("post_fire", 3, True, ["confined", "partial_gravity"], [], []), ("ignition", 4, False, ["elevated_o2", "low_pressure"], [], []),
]
TARGET = "STEEL"


def _list(xs: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"


def _values(rows) -> str:
    return ", ".join(f"('{r}', {s}, {str(t).lower()}, {_list(c)}, {_list(o)}, {_list(g)})" for r, s, t, c, o, g in rows)


RISK_SQL = f""", risks(risk, severity, scaled, conditions, outcomes, geometries) AS (VALUES {_values(RISKS)}),
hits AS (SELECT c.*, r.risk FROM claims c JOIN risks r ON list_contains(r.conditions, c.condition) AND (list_contains(r.outcomes, c.outcome) OR list_contains(r.geometries, c.geometry))),
papers AS (SELECT risk, paper_id, max(w) AS w, count(*) AS n, max(CASE WHEN fuel = (SELECT max(p_type) FROM part) THEN 1 ELSE 0 END) AS material, max(CASE WHEN study_type IN ('flight', 'both') THEN 1 ELSE 0 END) AS flight, max(seconds) AS longest FROM hits GROUP BY ALL),
found AS (SELECT risk, count(*) AS n_papers, CAST(sum(n) AS BIGINT) AS n_findings, CAST(sum(material) AS BIGINT) AS n_material, CAST(sum(flight) AS BIGINT) AS n_flight, max(longest) AS longest,
  round(1 - exp(-CAST(sum(w) AS DOUBLE) / 12.0), 6) AS strength,
  CASE WHEN 1 - exp(-CAST(sum(w) AS DOUBLE) / 12.0) >= 0.75 THEN 'strong' WHEN 1 - exp(-CAST(sum(w) AS DOUBLE) / 12.0) >= 0.45 THEN 'moderate' WHEN sum(w) > 0 THEN 'limited' ELSE 'none' END AS label FROM papers GROUP BY risk)"""


def _hits(s, d):
    return R.matched(claims(s, d), R.definitions(s, RISKS))


def _found(s, d):
    target = read(s, d, "part").agg(F.max("p_type")).first()[0]
    return R.evidence(_hits(s, d), target)


def _voted(s, d):
    return C.votes(claims(s, d))


def _cells(s, d):
    return V.matrix(claims(s, d), "fuel", "condition")


def _sparse(s, d):
    c = claims(s, d).withColumn("sup", F.col("suppkey").cast("string")).withColumn("part", (F.col("partkey") % 97).cast("string"))
    return V.matrix(c, "sup", "part")


def _series(s, d):
    return V.trend(claims(s, d), "condition")


def _links(s, d):
    return G.undirected(G.edges(by_paper(s, d)))


def _tagged(s, d):
    """Concepts of suppliers and parts by order: a sparse field, in which most pairs never meet."""
    c = by_paper(s, d).select(F.col("paper_id").alias("paper"), F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.concat(F.lit("s"), (F.col("suppkey") % 500).cast("string")).alias("concept")), F.struct(F.lit("b").alias("kind"), F.concat(F.lit("p"), (F.col("partkey") % 20).cast("string")).alias("concept")), F.struct(F.lit("c").alias("kind"), F.concat(F.lit("g"), (F.col("partkey") % 2000).cast("string")).alias("concept")))).alias("x"))
    return c.select("paper", "x.*").distinct()


def _profiles(s):
    return s.createDataFrame(PROFILES, "mission string, duration_days int, microgravity_days int, partial_gravity_days int, o2_percent double, pressure_kpa double")


def _cabins(s, d):
    """Profiles of missions, one for each part, some of them beyond bounds."""
    k, size = F.col("p_partkey"), F.col("p_size")
    days = lambda n: (k * n % 3500 - 40).cast("int")
    return read(s, d, "part").select(
        F.concat(F.lit("part "), k).alias("mission"), days(7).alias("duration_days"), days(11).alias("microgravity_days"), days(13).alias("partial_gravity_days"),
        (10 + size).cast("double").alias("o2_percent"), (20 + k % 120).cast("double").alias("pressure_kpa"),
    )


def _experiments(s, d):
    return claims(s, d).select(F.col("paper_id").alias("report"), F.col("fuel").alias("material"), F.col("seconds").alias("flow"), (F.col("confidence").cast("double") * 30).alias("oxygen"))


_PROFILE_SQL = ", ".join(f"('{m}', {a}, {b}, {c}, {e}, {f})" for m, a, b, c, e, f in PROFILES)
_BRIEF = f""", profiles(mission, days, mg, pg, o2, kpa) AS (VALUES {_PROFILE_SQL}),
mrisks(risk, severity, scaled, conditions, outcomes, geometries) AS (VALUES {_values(MISSION_RISKS)}),
expo AS (SELECT mission, days, unnest(['microgravity', 'partial_gravity', 'elevated_o2', 'low_pressure', 'confined']) AS condition,
  unnest([round(greatest(0, least(mg / 180.0, 1)), 6), round(greatest(0, least(pg / 180.0, 1)), 6), round(greatest(0, least((o2 - 21) / 13.0, 1)), 6), round(greatest(0, least((101.3 - kpa) / 44.8, 1)), 6), 0.6])::DOUBLE AS exposure FROM profiles),
most AS (SELECT mission, risk, max(exposure) AS exposure, max(severity) AS severity, bool_or(scaled) AS scaled, max(days) AS days FROM expo JOIN mrisks ON list_contains(conditions, condition) GROUP BY ALL),
parts AS (SELECT mission, risk, round(severity / 5.0::DOUBLE * CASE WHEN scaled THEN greatest(exposure / 2, greatest(0, least(days / 900.0::DOUBLE, 1))) ELSE exposure END, 3) AS relevance,
  round(1 - strength * (0.55 + 0.25 * least(3.0::DOUBLE * n_material / n_papers, 1) + 0.2 * least(n_flight / 10.0::DOUBLE, 1)), 3)::DOUBLE AS uncertainty, n_papers, n_material, n_flight FROM most JOIN found USING (risk)),
brief AS (SELECT *, round(relevance * (0.5::DOUBLE + 0.5::DOUBLE * uncertainty), 3) AS priority FROM parts)
SELECT mission, risk, relevance, uncertainty, priority, CASE WHEN priority >= 0.45 THEN 'high' WHEN priority >= 0.22 THEN 'medium' ELSE 'low' END AS tier,
  CAST((n_papers >= 10)::INT + (n_material >= 3)::INT + (n_flight >= 2)::INT + (uncertainty < 0.5)::INT + (relevance < 0.5)::INT AS INT) AS readiness FROM brief"""
_TAGGED = """, tagged AS (SELECT DISTINCT paper_id AS paper, kind, concept FROM (
  SELECT paper_id, 'a' AS kind, 's' || CAST(suppkey % 500 AS VARCHAR) AS concept FROM claims
  UNION ALL SELECT paper_id, 'b', 'p' || CAST(partkey % 20 AS VARCHAR) FROM claims
  UNION ALL SELECT paper_id, 'c', 'g' || CAST(partkey % 2000 AS VARCHAR) FROM claims)),
pairs AS (SELECT l.kind AS kx, l.concept AS x, r.kind AS ky, r.concept AS y, count(*) AS papers FROM tagged l JOIN tagged r ON l.paper = r.paper AND l.kind <> r.kind GROUP BY ALL),
met AS (SELECT p.x AS a, p.y AS b, q.y AS c, least(p.papers, q.papers) AS s FROM pairs p JOIN pairs q ON p.ky = q.kx AND p.y = q.x
  WHERE p.kx = 'a' AND q.ky = 'c' AND p.x <> q.y AND NOT EXISTS (SELECT 1 FROM pairs k WHERE k.kx = 'a' AND k.ky = 'c' AND k.x = p.x AND k.y = q.y)),
rk AS (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY s DESC, b) AS k FROM met)
SELECT a, c, count(*) AS bridges, CAST(sum(CASE WHEN k <= 5 THEN s END) AS BIGINT) AS score, min_by(b, k) AS best FROM rk GROUP BY a, c HAVING count(*) >= 2 ORDER BY score DESC, bridges DESC, a, c LIMIT 40"""


def _pagerank_sql(n: int = 100) -> str:
    steps = [W + EDGE_ROWS, "outw AS (SELECT s, sum(weight) AS total FROM nbr GROUP BY s)", "moves AS (SELECT nbr.s, nbr.t, weight / total AS p FROM nbr JOIN outw USING (s))", "r0 AS (SELECT s AS node, 1.0::DOUBLE / (SELECT count(*) FROM outw) AS rank FROM outw)"]
    for i in range(n):
        steps.append(f"r{i + 1} AS (SELECT t AS node, 0.15::DOUBLE / (SELECT count(*) FROM outw) + 0.85::DOUBLE * sum(p * rank) AS rank FROM moves JOIN r{i} ON s = node GROUP BY t)")
    return ", ".join(steps) + f" SELECT node, round(rank, 6) AS rank FROM r{n}"


_ISIN = "direction IN ('increase', 'decrease', 'no_change')"
QUERIES = {
    "consensus_groups": (lambda s, d: C.groups(_voted(s, d)), W + VOTES + GROUPS + " SELECT * FROM grp"),
    "consensus_timeline": (
        lambda s, d: C.timeline(_voted(s, d)),
        W + VOTES + f""", y AS (SELECT condition, outcome, geometry, year, count(*) FILTER (direction = 'increase') AS increase, count(*) FILTER (direction = 'decrease') AS decrease, count(*) FILTER (direction = 'no_change') AS no_change FROM voted WHERE year IS NOT NULL GROUP BY ALL)
        SELECT {_ID.format('')} AS id, year, CAST(sum(increase) OVER o AS BIGINT) AS increase, CAST(sum(decrease) OVER o AS BIGINT) AS decrease, CAST(sum(no_change) OVER o AS BIGINT) AS no_change FROM y
        WINDOW o AS (PARTITION BY condition, outcome, geometry ORDER BY year ROWS UNBOUNDED PRECEDING)""",
    ),
    "consensus_sides": (
        lambda s, d: C.sides(_voted(s, d)).select(C.group_id().alias("id"), "direction", "n", "first_paper", "last_paper", "fuels", "orbital", "earthbound", "shortest", "longest"),
        W + VOTES + f""" SELECT {_ID.format('')} AS id, direction, count(*) AS n, min(paper_id) AS first_paper, max(paper_id) AS last_paper, array_to_string(list_sort(list(DISTINCT coalesce(fuel, 'None'))), ',') AS fuels,
        bool_or(study_type IN ('flight', 'both')) AS orbital, bool_or(study_type IN ('short_ug', 'ground')) AS earthbound, min(CASE WHEN seconds > 0 THEN seconds END) AS shortest, max(seconds) AS longest FROM voted GROUP BY condition, outcome, geometry, direction""",
    ),
    "conflict_explanations": (
        lambda s, d: C.explanations(_voted(s, d)),
        W + VOTES + GROUPS + """, sd AS (SELECT condition, outcome, geometry, direction, array_to_string(list_sort(list(DISTINCT coalesce(fuel, 'None'))), ',') AS fuels, bool_or(study_type IN ('flight', 'both')) AS orbital, bool_or(study_type IN ('short_ug', 'ground')) AS earth, min(CASE WHEN seconds > 0 THEN seconds END) AS lo, max(seconds) AS hi FROM voted GROUP BY ALL),
        ex AS (SELECT condition, outcome, geometry, count(DISTINCT fuels) > 1 AS f, bool_or(orbital) AND bool_or(earth) AS g, max(hi) > 3 * min(lo) AS t FROM sd GROUP BY ALL)
        SELECT id, CASE WHEN f OR g OR t THEN concat_ws(',', CASE WHEN f THEN 'materials' END, CASE WHEN g THEN 'gravity' END, CASE WHEN t THEN 'durations' END) ELSE 'unexplained' END AS why FROM grp JOIN ex USING (condition, outcome, geometry) WHERE status = 'contradictory'""",
    ),
    "novelty": (
        lambda s, d: C.novelty(_voted(s, d)),
        W + VOTES + GROUPS + """ SELECT id, paper_id, year, v.direction, majority, n_papers FROM voted v JOIN grp USING (condition, outcome, geometry) WHERE status <> 'emerging' AND n_papers >= 3 AND v.direction <> majority AND year > (SELECT max(year) FROM voted) - 2 ORDER BY year DESC, n_papers DESC, id, paper_id LIMIT 30""",
    ),
    "takeaways": (
        lambda s, d: C.takeaways(_voted(s, d)),
        W + VOTES + GROUPS + """, busy AS (SELECT geometry FROM voted GROUP BY geometry HAVING count(DISTINCT paper_id) >= 5),
        rk AS (SELECT *, row_number() OVER (PARTITION BY geometry, status ORDER BY n_papers DESC, id) AS rank FROM grp WHERE status IN ('consensus', 'contradictory') AND geometry IN (SELECT geometry FROM busy))
        SELECT geometry, status, rank, id, majority, n_papers, CAST(floor(round(agreement * 100, 4)) AS BIGINT) AS percent FROM rk WHERE (status = 'consensus' AND rank <= 3) OR rank <= 2""",
    ),
    "coverage_matrix": (lambda s, d: _cells(s, d), W + CELLS + " SELECT * FROM cells"),
    "coverage_grid": (
        lambda s, d: V.full_matrix(_sparse(s, d), read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("row")), s.range(97).select(F.col("id").cast("string").alias("col"))),
        W + SPARSE + """ SELECT CAST(s_suppkey AS VARCHAR) AS row, CAST(i AS VARCHAR) AS col, coalesce(papers, 0) AS papers, coalesce(flight, 0) AS flight FROM supplier CROSS JOIN range(97) r(i) LEFT JOIN cells ON row = CAST(s_suppkey AS VARCHAR) AND col = CAST(i AS VARCHAR)""",
    ),
    "undercovered_cells": (
        lambda s, d: V.undercovered(_sparse(s, d), 1.0, 0.5, 50),
        W + SPARSE + """, r AS (SELECT row, sum(papers) AS rt FROM cells GROUP BY row), k AS (SELECT col, sum(papers) AS ct FROM cells GROUP BY col), g AS (SELECT sum(papers) AS t FROM cells),
        f AS (SELECT row, col, coalesce(papers, 0) AS observed, round(rt * ct / t, 6) AS expected FROM r CROSS JOIN k CROSS JOIN g LEFT JOIN cells USING (row, col))
        SELECT row, col, observed, expected, round(expected - observed, 6) AS deficit FROM f WHERE expected >= 1 AND observed <= 0.5 * expected ORDER BY deficit DESC, row, col LIMIT 50""",
    ),
    "matrix_row_totals": (lambda s, d: V.row_totals(_cells(s, d), True), W + CELLS + " SELECT row, CAST(sum(flight) AS BIGINT) AS total FROM cells GROUP BY row HAVING sum(flight) > 0"),
    "group_bias": (
        lambda s, d: V.group_bias(claims(s, d), "geometry", "study_type", "flight"),
        W + """, p AS (SELECT geometry, paper_id, max(CASE WHEN study_type = 'flight' THEN 1 ELSE 0 END) AS hit FROM claims GROUP BY ALL) SELECT geometry, count(*) AS papers, CAST(sum(hit) AS BIGINT) AS on_target, round(sum(hit) / count(*), 6) AS share, sum(hit) / count(*) < 0.15 AS flagged FROM p GROUP BY geometry HAVING count(*) >= 5""",
    ),
    "duration_gap": (
        lambda s, d: V.duration_gap(claims(s, d), "condition"),
        W + """ SELECT condition, count(*) AS n, max(seconds) AS longest, list_sort(list(seconds))[(count(*) // 2) + 1] AS median, count(*) FILTER (seconds < 10) AS b0, count(*) FILTER (seconds >= 10 AND seconds < 25) AS b1, count(*) FILTER (seconds >= 25 AND seconds < 40) AS b2, count(*) FILTER (seconds >= 40) AS b3 FROM claims GROUP BY condition HAVING count(*) >= 3""",
    ),
    "trend_series": (lambda s, d: _series(s, d), W + SERIES + " SELECT * FROM series"),
    "trend_cumulative": (lambda s, d: V.cumulative(_series(s, d)), W + SERIES + " SELECT label, year, CAST(sum(papers) OVER (PARTITION BY label ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS papers FROM series"),
    "trend_growth": (
        lambda s, d: V.growth(_series(s, d)),
        W + SERIES + """, y AS (SELECT year, ntile(2) OVER (ORDER BY year DESC) AS half FROM (SELECT DISTINCT year FROM series)) SELECT label, CAST(sum(papers) AS BIGINT) AS total, CAST(sum(CASE WHEN half = 1 THEN papers ELSE 0 END) AS BIGINT) AS late, round(sum(CASE WHEN half = 1 THEN papers ELSE 0 END) / sum(papers), 6) AS late_share FROM series JOIN y USING (year) GROUP BY label HAVING sum(papers) >= 8""",
    ),
    "study_mix": (
        lambda s, d: V.study_mix(claims(s, d)),
        W + """, st AS (SELECT study_type AS label, year, count(DISTINCT paper_id) AS papers FROM claims GROUP BY ALL) SELECT l.label, y.year, coalesce(papers, 0) AS papers FROM (SELECT DISTINCT label FROM st) l CROSS JOIN (SELECT DISTINCT year FROM st) y LEFT JOIN st ON st.label = l.label AND st.year = y.year""",
    ),
    "matrix_pivot": (
        lambda s, d: V.pivoted(V.matrix(claims(s, d), "condition", "direction"), ["increase", "decrease", "no_change"]),
        W + """ SELECT condition AS row, count(DISTINCT CASE WHEN direction = 'increase' THEN paper_id END) AS increase, count(DISTINCT CASE WHEN direction = 'decrease' THEN paper_id END) AS decrease, count(DISTINCT CASE WHEN direction = 'no_change' THEN paper_id END) AS no_change FROM claims GROUP BY condition""",
    ),
    "graph_nodes": (
        lambda s, d: G.nodes(claims(s, d), ("condition", "outcome", "geometry", "fuel", "countermeasure")),
        W + ", m AS (" + " UNION ALL ".join(f"SELECT '{r}:' || {r} AS node, paper_id, study_type FROM claims" for r in ("condition", "outcome", "geometry", "fuel", "countermeasure")) + ") SELECT node, count(DISTINCT paper_id) AS papers, count(DISTINCT CASE WHEN study_type IN ('flight', 'both') THEN paper_id END) AS flight_papers FROM m WHERE node IS NOT NULL GROUP BY node",
    ),
    "graph_edges": (lambda s, d: G.edges(by_paper(s, d)), W + EDGE_ROWS + " SELECT * FROM edges"),
    "graph_undirected": (lambda s, d: _links(s, d), W + EDGE_ROWS + " SELECT * FROM links"),
    "graph_year_edges": (
        lambda s, d: G.edges(G.in_years(claims(s, d), 1996, 1997)).select("src", "rel", "dst", "papers"),
        W.replace("JOIN customer ON o_custkey = c_custkey", "JOIN customer ON o_custkey = c_custkey WHERE coalesce(year(o_orderdate), 0) BETWEEN 1996 AND 1997") + EDGE_ROWS + " SELECT src, rel, dst, papers FROM edges",
    ),
    "graph_pagerank": (lambda s, d: G.pagerank(cut(_links(s, d))).select("node", F.round("rank", 6).alias("rank")), _pagerank_sql()),
    "graph_within": (
        lambda s, d: G.within(_links(s, d).where("weight >= 40"), ["condition:Brand#11"], 2),
        W + EDGE_ROWS + """, n2 AS (SELECT * FROM nbr WHERE weight >= 40), d1 AS (SELECT DISTINCT t AS node FROM n2 WHERE s = 'condition:Brand#11'), d2 AS (SELECT DISTINCT t AS node FROM n2 WHERE s IN (SELECT node FROM d1))
        SELECT 'condition:Brand#11' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 WHERE node NOT IN (SELECT node FROM d1) AND node <> 'condition:Brand#11'""",
    ),
    "graph_paths": (
        lambda s, d: G.shortest_paths(cut(_links(s, d)), "countermeasure:cm1", "geometry:BUILDING", 5),
        # paths of three hops at most bound the length of the fifth; whatever is no longer is walked to its end
        "WITH RECURSIVE" + (W + EDGE_ROWS).removeprefix("WITH") + """, h AS (SELECT 1.0::DOUBLE / weight AS len FROM nbr WHERE s = 'countermeasure:cm1' AND t = 'geometry:BUILDING'
          UNION ALL SELECT 1.0::DOUBLE / x.weight + 1.0::DOUBLE / y.weight FROM nbr x JOIN nbr y ON x.t = y.s WHERE x.s = 'countermeasure:cm1' AND y.t = 'geometry:BUILDING' AND x.t <> 'geometry:BUILDING'
          UNION ALL SELECT 1.0::DOUBLE / x.weight + 1.0::DOUBLE / y.weight + 1.0::DOUBLE / z.weight FROM nbr x JOIN nbr y ON x.t = y.s JOIN nbr z ON y.t = z.s WHERE x.s = 'countermeasure:cm1' AND z.t = 'geometry:BUILDING' AND x.t <> 'geometry:BUILDING' AND y.t NOT IN ('geometry:BUILDING', 'countermeasure:cm1', x.t)),
        most AS (SELECT max(len) AS most FROM (SELECT len FROM h ORDER BY len LIMIT 5)),
        walk AS (SELECT ['countermeasure:cm1'] AS path, 'countermeasure:cm1' AS node, 0.0::DOUBLE AS len, CAST(NULL AS HUGEINT) AS support
          UNION ALL SELECT list_append(path, t), t, len + 1.0::DOUBLE / weight, least(support, CAST(weight AS HUGEINT)) FROM walk JOIN nbr ON node = s CROSS JOIN most WHERE node <> 'geometry:BUILDING' AND NOT list_contains(path, t) AND len + 1.0::DOUBLE / weight <= most * (1 + 1e-9))
        SELECT array_to_string(path, ' > ') AS path, round(len, 9) AS length, CAST(support AS BIGINT) AS support FROM walk WHERE node = 'geometry:BUILDING' ORDER BY length, path LIMIT 5""",
    ),
    "graph_key_links": (
        lambda s, d: G.key_links(_links(s, d)),
        W + EDGE_ROWS + """, e2 AS (SELECT a AS node, a, b, weight FROM links UNION ALL SELECT b, a, b, weight FROM links) SELECT DISTINCT a, b, weight FROM (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, a, b) <= 2)""",
    ),
    "graph_round_robin": (
        lambda s, d: G.round_robin(G.nodes(claims(s, d), ("condition", "outcome", "geometry")), 20),
        W + ", m AS (" + " UNION ALL ".join(f"SELECT '{r}:' || {r} AS node, '{r}' AS kind, paper_id FROM claims" for r in ("condition", "outcome", "geometry")) + "), n AS (SELECT node, kind, count(DISTINCT paper_id) AS papers FROM m GROUP BY ALL) SELECT node, kind, row_number() OVER (PARTITION BY kind ORDER BY papers DESC, node) AS turn, papers FROM n ORDER BY turn, papers DESC, node LIMIT 20",
    ),
    "graph_betweenness": (lambda s, d: G.betweenness(cut(_links(s, d))).select("node", F.round("betweenness", 6).alias("betweenness")), None),
    "graph_communities": (lambda s, d: G.communities(_links(s, d)), None),
    "graph_modularity": (lambda s, d: G.modularity_communities(cut(_links(s, d))), None),
    "risk_evidence": (lambda s, d: _found(s, d), W + RISK_SQL + " SELECT * FROM found"),
    "risk_countermeasures": (
        lambda s, d: R.countermeasures(_hits(s, d)),
        W + RISK_SQL + """, cm AS (SELECT risk, countermeasure, CAST(sum(CASE WHEN effect = 'ineffective' THEN 0 ELSE 1 END) AS BIGINT) AS effective, CAST(sum(CASE WHEN effect = 'ineffective' THEN 1 ELSE 0 END) AS BIGINT) AS ineffective, count(DISTINCT paper_id) AS papers FROM hits WHERE countermeasure IS NOT NULL GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY risk ORDER BY 3 * effective + papers DESC, countermeasure) AS rank FROM cm QUALIFY rank <= 6""",
    ),
    "risk_key_findings": (lambda s, d: R.key_findings(_hits(s, d)), W + RISK_SQL + " SELECT risk, row_number() OVER (PARTITION BY risk ORDER BY w DESC, paper_id) AS rank, paper_id, CAST(w AS DOUBLE) AS w FROM papers QUALIFY rank <= 8"),
    "mission_briefing": (lambda s, d: R.briefing(_profiles(s), R.definitions(s, MISSION_RISKS), _found(s, d)), W + RISK_SQL + _BRIEF),
    "mission_atmosphere": (
        lambda s, d: R.atmosphere(_cabins(s, d)),
        "SELECT 'part ' || p_partkey AS mission, round((20 + p_partkey % 120)::DOUBLE / 6.895::DOUBLE, 1) AS psia, round((20 + p_partkey % 120)::DOUBLE * (10 + p_size)::DOUBLE / 100, 1) AS pp_o2 FROM part",
    ),
    "abc_hypotheses": (lambda s, d: D.hypotheses(cut(D.pair_papers(_tagged(s, d))), ("a",), ("c",)), W + _TAGGED),
    "envelope": (
        lambda s, d: P.envelope(_experiments(s, d), ("flow", "oxygen")),
        W + """ SELECT 'flow' AS field, greatest(min(seconds) - 1, 0) AS low, max(seconds) + 1 AS high FROM claims UNION ALL SELECT 'oxygen', greatest(min(confidence::DOUBLE * 30) - 1, 0), max(confidence::DOUBLE * 30) + 1 FROM claims""",
    ),
    "nearest_reports": (
        lambda s, d: P.nearest_reports(_experiments(s, d), (20.5, 23.1), ("flow", "oxygen"), (10.0, 5.0), "ECONOMY"),
        W + """ SELECT paper_id AS report, min(round(CASE WHEN fuel = 'ECONOMY' THEN 0.0 ELSE 0.5 END + pow((seconds - 20.5::DOUBLE) / 10.0::DOUBLE, 2) + pow((confidence::DOUBLE * 30 - 23.1::DOUBLE) / 5.0::DOUBLE, 2), 6)) AS d FROM claims GROUP BY paper_id ORDER BY d, report LIMIT 3""",
    ),
    "oxygen_sweep": (
        lambda s, d: P.sweep(P.envelope(_experiments(s, d), ("oxygen",)), 10.0, 40.0),
        W + """, e AS (SELECT greatest(min(confidence::DOUBLE * 30) - 1, 0) AS low, max(confidence::DOUBLE * 30) + 1 AS high FROM claims) SELECT CAST(i AS INT) AS i, round(10.0::DOUBLE + i * (30.0::DOUBLE / 25), 6) AS value, round(10.0::DOUBLE + i * (30.0::DOUBLE / 25), 6) BETWEEN low AND high AS inside FROM range(26) r(i) CROSS JOIN e""",
    ),
}
