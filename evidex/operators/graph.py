"""The concept graph: nodes, evidence edges, centrality, neighbourhoods and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.lineage import cut
from evidex.plans.claims import strength

#: Relation: source role, target role.  A null or equal pair makes no edge.
RELATIONS = (("affects", "condition", "outcome"), ("burned_in", "fuel", "condition"), ("observed_in", "outcome", "geometry"))


def mentions(claims: DataFrame, roles: Sequence[str]) -> DataFrame:
    """One row per claim and role: the concept as ``role:value``, with its report."""
    each = F.explode(F.array(*(F.when(F.col(r).isNotNull(), F.concat(F.lit(f"{r}:"), F.col(r).cast("string"))) for r in roles)))
    return claims.select("paper_id", "study_type", each.alias("node")).where("node is not null")


def nodes(claims: DataFrame, roles: Sequence[str]) -> DataFrame:
    flight = F.when(F.col("study_type").isin("flight", "both"), F.col("paper_id"))
    return mentions(claims, roles).groupBy("node").agg(F.count_distinct("paper_id").alias("papers"), F.count_distinct(flight).alias("flight_papers"))


def edge_rows(claims: DataFrame) -> DataFrame:
    """One row per claim and relation, in one pass over the claims."""
    concept = lambda r: F.when(F.col(r).isNotNull(), F.concat(F.lit(f"{r}:"), F.col(r).cast("string")))
    acts = F.when(F.col("effect") == "ineffective", "fails_to_mitigate").otherwise("mitigates")
    made = [F.struct(F.lit(rel).alias("rel"), concept(a).alias("src"), concept(b).alias("dst")) for rel, a, b in RELATIONS]
    made.append(F.struct(acts.alias("rel"), concept("countermeasure").alias("src"), concept("outcome").alias("dst")))
    rows = claims.select("paper_id", "direction", "w", F.explode(F.array(*made)).alias("e")).select("paper_id", "direction", "w", "e.*")
    return rows.where("src is not null and dst is not null and src <> dst")


def edges(claims: DataFrame) -> DataFrame:
    """Reports, votes, majority, agreement and strength of each (source, relation, target)."""
    by = F.sum
    votes = {d: by((F.col("direction") == d).cast("long")) for d in ("increase", "decrease", "no_change")}
    rolled = edge_rows(claims).groupBy("src", "rel", "dst").agg(F.count_distinct("paper_id").alias("papers"), F.count("*").alias("findings"), by("w").alias("total"), *(v.alias(d) for d, v in votes.items()))
    top = F.greatest("increase", "decrease", "no_change")
    return rolled.select(
        "src", "rel", "dst", "papers", "findings", "increase", "decrease", "no_change",
        F.when(F.col("increase") == top, "increase").when(F.col("decrease") == top, "decrease").otherwise("no_change").alias("majority"),
        F.round(top / F.col("findings"), 6).alias("agreement"), F.round(strength(F.col("total")), 6).alias("strength"),
    )


def undirected(edge_table: DataFrame) -> DataFrame:
    """Parallel and opposite edges added up; distance is one over the weight."""
    return edge_table.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("papers").alias("weight"))


def pagerank(links: DataFrame, damping: float = 0.85, iterations: int = 100, checkpoint_every: int = 10) -> DataFrame:
    """Weighted PageRank by power iteration: one join and one sum a step, lineage cut in the shared folder."""
    both = links.select(F.col("a").alias("s"), F.col("b").alias("t"), "weight").unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("t"), "weight"))
    out = both.groupBy("s").agg(F.sum("weight").alias("total"))
    moves = both.join(out, "s").select("s", "t", (F.col("weight") / F.col("total")).alias("p"))
    n = out.count()
    rank = out.select(F.col("s").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for step in range(1, iterations + 1):
        gained = moves.join(rank, F.col("s") == F.col("node")).groupBy("t").agg(F.sum(F.col("p") * F.col("rank")).alias("g"))
        rank = gained.select(F.col("t").alias("node"), ((1 - damping) / max(n, 1) + damping * F.col("g")).alias("rank"))
        if step % checkpoint_every == 0 and step < iterations:
            rank = cut(rank)
    return rank


def within(links: DataFrame, focus: Sequence[str], depth: int = 2) -> DataFrame:
    """Concepts reachable from ``focus`` in ``depth`` steps, with the fewest steps needed."""
    spark = links.sparkSession
    # links are made once, not once for each direction and step
    both = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("x")).select("x.*").distinct())
    reached = spark.createDataFrame([(f, 0) for f in focus], "node string, depth int")
    frontier = reached
    for step in range(1, depth + 1):
        found = both.join(frontier, F.col("s") == F.col("node"), "left_semi").select(F.col("t").alias("node")).distinct()
        frontier = found.join(reached, "node", "left_anti").withColumn("depth", F.lit(step))
        reached = reached.unionByName(frontier)
    return reached


def strongest_paths(links: DataFrame, source: str, target: str, hops: int = 3, k: int = 3) -> DataFrame:
    """The k shortest simple paths of at most ``hops`` edges, length one over weight; support is the least weight.

    Grows from both ends, so the middle join meets only concepts near both.
    """
    both = links.select(F.col("a").alias("s"), F.col("b").alias("t"), "weight").union(links.select("b", "a", "weight"))
    paths = both.where(F.col("s") == source).select(F.array("s", "t").alias("path"), F.col("t").alias("end"), (1 / F.col("weight")).alias("length"), F.col("weight").alias("support"))
    done = paths.where(F.col("end") == target)
    for step in range(2, hops + 1):
        onward = both.where(F.col("t") == target) if step == hops else both
        open_paths = paths.where(F.col("end") != target)
        paths = open_paths.join(onward, (F.col("end") == F.col("s")) & ~F.array_contains("path", F.col("t"))).select(
            F.concat("path", F.array("t")).alias("path"), F.col("t").alias("end"), (F.col("length") + 1 / F.col("weight")).alias("length"), F.least("support", "weight").alias("support")
        )
        done = done.unionByName(paths.where(F.col("end") == target))
    return done.select(F.array_join("path", " > ").alias("path"), F.round("length", 9).alias("length"), "support").orderBy("length", "path").limit(k)


def key_links(links: DataFrame, per_node: int = 2) -> DataFrame:
    """Each concept's strongest links, each link once."""
    both = links.select(F.col("a").alias("node"), "a", "b", "weight").unionByName(links.select(F.col("b").alias("node"), "a", "b", "weight"))
    best = Window.partitionBy("node").orderBy(F.desc("weight"), "a", "b")
    return both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_node).select("a", "b", "weight").distinct()


def round_robin(node_table: DataFrame, top: int) -> DataFrame:
    """The leading concepts, taking one of each kind in turn; a top list."""
    kind = F.substring_index("node", ":", 1)
    turn = Window.partitionBy("kind").orderBy(F.desc("papers"), "node")
    return node_table.withColumn("kind", kind).withColumn("turn", F.row_number().over(turn)).orderBy("turn", F.desc("papers"), "node").limit(top).select("node", "kind", "turn", "papers")


def in_years(claims: DataFrame, low: int, high: int) -> DataFrame:
    """Claims of a span of years; a missing year counts as zero, so it fails any lower bound above."""
    y = F.coalesce("year", F.lit(0))
    return claims.where((y >= low) & (y <= high))


def betweenness(links: DataFrame, sources_per_block: int = 2000) -> DataFrame:
    """(node, betweenness): weighted, normalised, of an undirected graph; distance is one over the weight.

    Brandes' sums over (source, node) tables: distances by relaxing the frontier, path counts and
    dependencies along the edges of shortest paths, each step one join and one sum.  Paths whose
    lengths differ by less than a part in 10**12 count as equal.  Sources are taken in blocks, so a
    block's tables hold at most ``sources_per_block`` rows for each node on average.  An empty graph gives no rows.
    """
    there = links.select(F.col("a").alias("s"), F.col("b").alias("t"), (1.0 / F.col("weight")).alias("length"))
    steps = cut(there.unionByName(there.select(F.col("t").alias("s"), F.col("s").alias("t"), "length")).where("s <> t"))
    nodes = steps.select(F.col("s").alias("node")).distinct()
    n = nodes.count()
    blocks = max(1, -(-n // sources_per_block))
    parts = nodes.select("node", F.lit(0.0).alias("e"))
    for k in range(blocks):
        parts = parts.unionByName(_dependencies(steps, nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k)))
    n = max(n, 3)
    return parts.groupBy("node").agg((F.sum("e") / ((n - 1) * (n - 2))).alias("betweenness"))


def _dependencies(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, e): how much the shortest paths from ``sources`` depend on each node between, in parts to be added up."""
    start = sources.select(F.col("node").alias("source"), "node")
    far = fresh = cut(start.withColumn("d", F.lit(0.0)))
    while not fresh.isEmpty():
        offered = fresh.join(steps, F.col("node") == F.col("s")).groupBy("source", F.col("t").alias("node")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
        met = cut(far.select("source", "node", "d").join(offered, ["source", "node"], "full").withColumn("better", F.col("new").isNotNull() & (F.col("d").isNull() | (F.col("new") < F.col("d") * (1 - 1e-12)))))
        far = met.select("source", "node", F.when(F.col("better"), F.col("new")).otherwise(F.col("d")).alias("d"))
        fresh = met.where("better").select("source", "node", F.col("new").alias("d"))

    ends = far.select("source", F.col("node").alias("t"), F.col("d").alias("upto"))
    along = cut(far.join(steps, F.col("node") == F.col("s")).join(ends, ["source", "t"]).where(F.col("d") + F.col("length") <= F.col("upto") * (1 + 1e-12)).select("source", F.col("node").alias("u"), F.col("t").alias("v")))

    level = cut(start.withColumn("c", F.lit(1.0)))
    counts = level
    while not level.isEmpty():
        level = cut(level.withColumnRenamed("node", "u").join(along, ["source", "u"]).groupBy("source", F.col("v").alias("node")).agg(F.sum("c").alias("c")))
        counts = counts.unionByName(level)
    counts = cut(counts.groupBy("source", "node").agg(F.sum("c").alias("c")))

    of_u, of_v = counts.select("source", F.col("node").alias("u"), F.col("c").alias("cu")), counts.select("source", F.col("node").alias("v"), F.col("c").alias("cv"))
    share = cut(along.where("u <> source").join(of_u, ["source", "u"]).join(of_v, ["source", "v"]).select("source", "u", "v", (F.col("cu") / F.col("cv")).alias("share")))
    level = cut(counts.where("node <> source").select("source", "node", F.lit(1.0).alias("e")))
    out = level.where(F.lit(False)).select("node", "e")
    while not level.isEmpty():
        level = cut(level.withColumnRenamed("node", "v").join(share, ["source", "v"]).groupBy("source", F.col("u").alias("node")).agg(F.sum(F.col("e") * F.col("share")).alias("e")))
        out = out.unionByName(level.groupBy("node").agg(F.sum("e").alias("e")))
    return out


def communities(links: DataFrame) -> DataFrame:
    """Label propagation until labels repeat: each concept takes the label of the greatest weight around it, ties to the least label.

    All concepts move at once, so labels may end in a cycle of states rather than in one; each
    concept then gets the least label it has in the cycle.
    """
    both = cut(links.select(F.col("a").alias("s"), F.col("b").alias("t"), "weight").unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("t"), "weight")))
    label = cut(both.select(F.col("s").alias("node"), F.col("s").alias("label")).distinct())
    best = Window.partitionBy("s").orderBy(F.desc("w"), "label")
    seen, states = [], []
    while True:
        mark = tuple(label.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(k), "node", "label").cast("decimal(38,0)")) for k in (0, 1))).first())
        if mark in seen:
            break
        seen.append(mark)
        states.append(label)
        around = both.join(label, F.col("t") == F.col("node")).groupBy("s", "label").agg(F.sum("weight").alias("w"))
        label = cut(around.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("s").alias("node"), "label"))
    cycle = states[seen.index(mark) :]
    every = cycle[0]
    for state in cycle[1:]:
        every = every.unionByName(state)
    return every.groupBy("node").agg(F.min("label").alias("label"))


def context_edges(claims: DataFrame) -> DataFrame:
    """(src, rel, dst, papers, findings): ``implicated_in`` for each of a claim's species, ``hosted`` from its platform to its first fuel.

    These tell no direction.  ``claims`` has (paper_id, outcome, species array, platform, fuels array); nulls, empty
    arrays and pairs of the same concept make no edge.
    """
    concept = lambda role, c: F.when(c.isNotNull(), F.concat(F.lit(f"{role}:"), c))
    edge = lambda rel, a, b: F.struct(F.lit(rel).alias("rel"), a.alias("src"), b.alias("dst"))
    outcome = concept("outcome", F.col("outcome"))
    acting = F.transform(F.coalesce("species", F.array().cast("array<string>")), lambda x: edge("implicated_in", concept("species", x), outcome))
    made = F.concat(acting, F.array(edge("hosted", concept("platform", F.col("platform")), concept("fuel", F.get("fuels", F.lit(0))))))
    each = claims.select("paper_id", F.explode(made).alias("x")).select("paper_id", "x.*").where("src is not null and dst is not null and src <> dst")
    return each.groupBy("src", "rel", "dst").agg(F.count_distinct("paper_id").alias("papers"), F.count("*").alias("findings"))


def subgraph(edge_table: DataFrame, kinds: Sequence[str] = (), nodes: Sequence[str] = (), least: int = 2, focus: str | None = None, depth: int = 1, limit: int = 160, members: DataFrame | None = None, community: int | None = None) -> DataFrame:
    """Edges to show: both ends of the kinds (or among the nodes) asked for, ``least`` reports, within ``depth`` of a focus; a top list of twice ``limit``.

    Explicit ``nodes`` make ``kinds`` irrelevant; with ``members`` (node, community) both ends are of one ``community``.
    Concepts are named ``kind:value``.
    """
    kept = edge_table.where(F.col("papers") >= least)
    for end in ("src", "dst"):
        if nodes:
            kept = kept.where(F.col(end).isin(*nodes))
        elif kinds:
            kept = kept.where(F.substring_index(end, ":", 1).isin(*kinds))
    if members is not None and community is not None:
        inside = members.where(F.col("community") == community).select("node")
        for end in ("src", "dst"):
            kept = kept.join(inside.withColumnRenamed("node", end), end, "left_semi")
        kept = kept.select(*edge_table.columns)
    if focus:
        pairs = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        near = within(pairs, [focus], max(depth, 1)).select("node")
        for end in ("src", "dst"):
            kept = kept.join(near.withColumnRenamed("node", end), end, "left_semi")
    return kept.orderBy(F.desc("papers"), "src", "rel", "dst").limit(2 * limit)


#: Links of a contracted graph that the driver can hold: from there on rounds of merging need no jobs.
FEW_LINKS = 20_000


def modularity_communities(links: DataFrame, resolution: float = 1.2, few: int = FEW_LINKS) -> DataFrame:
    """(node, community): communities of greatest modularity as far as merging finds it, numbered from 0 by size, the largest first.

    Every node begins as a community of its own.  In each round a community looks for the neighbour with which a
    merger gains most, ties to the least names, and pairs that choose each other merge; pairs don't touch, so their
    gains add up, and the best of all pairs is always among them.  Rounds end when no merger gains.  Each is a join
    and two sums over the contracted graph, so tables shrink as communities grow; once it has at most ``few`` links,
    the rounds that are left run on the driver, by the same rule.  Communities of one size are numbered by their
    least member; an empty graph gives no rows.
    """
    spark = links.sparkSession
    edges = cut(links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w")))
    degree = cut(edges.select(F.col("a").alias("c"), "w").unionByName(edges.select(F.col("b").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k")))
    total = edges.agg(F.sum("w")).first()[0]
    label = degree.select(F.col("c").alias("node"), F.col("c").alias("community"))
    while total:
        if edges.count() <= few:
            merged = _merged(edges.collect(), dict(map(tuple, degree.join(edges.select(F.col("a").alias("c")).union(edges.select("b")).distinct(), "c", "left_semi").collect())), total, resolution)
            if merged:
                label = _renamed(label, spark.createDataFrame(merged, "old string, new string"), "community")
            break
        sides = edges.join(degree.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b")
        fit = sides.withColumn("gain", F.col("w") / total - resolution * F.col("ka") * F.col("kb") / (2.0 * total * total)).where(F.col("gain") > 1e-15)
        both = fit.select(F.col("a").alias("c"), F.col("b").alias("other"), "gain").unionByName(fit.select(F.col("b").alias("c"), F.col("a").alias("other"), "gain"))
        chosen = both.groupBy("c").agg(F.min_by("other", F.struct(-F.col("gain"), F.least("c", "other"), F.greatest("c", "other"))).alias("other"))
        back = chosen.select(F.col("other").alias("c"), F.col("c").alias("other"))
        merged = cut(chosen.where("other < c").join(back, ["c", "other"]).select(F.col("c").alias("old"), F.col("other").alias("new")))
        if merged.isEmpty():
            break
        label = cut(_renamed(label, merged, "community"))
        moved = _renamed(_renamed(edges, merged, "a"), merged, "b").where("a <> b")
        edges = cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
        degree = cut(_renamed(degree, merged, "c").groupBy("c").agg(F.sum("k").alias("k")))
    sizes = label.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    return label.join(_numbered(sizes, F.desc("size"), F.col("least")).select("community", "number"), "community").select("node", F.col("number").alias("community"))


def _renamed(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    return df.join(merged, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def _merged(edges: list, degree: dict, total: float, resolution: float) -> list[tuple[str, str]]:
    """(old, new) of the communities that end up in others, by rounds of mutual best mergers of a small graph."""
    weight = {(a, b): w for a, b, w in edges}
    into = {c: c for c in degree}
    while True:
        chosen: dict[str, tuple] = {}
        for (a, b), w in weight.items():
            gain = w / total - resolution * degree[a] * degree[b] / (2.0 * total * total)
            if gain > 1e-15:
                for c, other in ((a, b), (b, a)):
                    chosen[c] = min(chosen.get(c, (0.0,)), (-gain, a, b, other))
        pairs = {c: x[3] for c, x in chosen.items() if x[3] < c and chosen[x[3]][3] == c}
        if not pairs:
            return [(c, n) for c, n in into.items() if c != n]
        into = {c: pairs.get(n, n) for c, n in into.items()}
        rolled: dict[tuple[str, str], float] = {}
        for (a, b), w in weight.items():
            a, b = pairs.get(a, a), pairs.get(b, b)
            if a != b:
                key = (min(a, b), max(a, b))
                rolled[key] = rolled.get(key, 0.0) + w
        weight = rolled
        for old, new in pairs.items():
            degree[new] += degree.pop(old)


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """Adds ``number``, the place of each row in an order, from 0: rows are sorted over partitions, of which the sizes are added up before."""
    placed = cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(F.broadcast(starts.select("_part", "_first", "_start")), "_part").withColumn("number", (F.col("_start") + F.col("_at") - F.col("_first")).cast("int")).drop("_part", "_at", "_first", "_start")


def modularity(links: DataFrame, members: DataFrame, resolution: float = 1.2) -> float:
    """Of a division (node, community): the share of weight within communities, less what chance puts there; 0.0 without links."""
    own = links.where("a <> b").join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    total = own.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    inside = own.where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    degrees = own.select(F.col("ca").alias("c"), "weight").unionByName(own.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").cast("double").alias("k"))
    return float(inside) / float(total) - resolution * degrees.agg(F.sum(F.pow(F.col("k") / (2.0 * float(total)), 2))).first()[0]


def weakest(edge_table: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, weight): one link for each pair of concepts; of parallel and opposite edges the one of fewest reports."""
    return edge_table.where(F.col("papers") >= least).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("papers").alias("weight"))


def distances(links: DataFrame, target: str) -> DataFrame:
    """(node, d): least length of a path to ``target``, a link being one over its weight long; concepts without one are left out."""
    spark = links.sparkSession
    both = cut(links.select(F.col("a").alias("s"), F.col("b").alias("t"), (1.0 / F.col("weight")).alias("length")).union(links.select("b", "a", 1.0 / F.col("weight"))).where("s <> t"))
    far = fresh = spark.createDataFrame([(target, 0.0)], "node string, d double")
    while not fresh.isEmpty():
        offered = fresh.join(both, F.col("node") == F.col("s")).groupBy(F.col("t").alias("node")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
        met = cut(far.join(offered, "node", "full").withColumn("better", F.col("new").isNotNull() & (F.col("d").isNull() | (F.col("new") < F.col("d")))))
        far = met.select("node", F.when(F.col("better"), F.col("new")).otherwise(F.col("d")).alias("d"))
        fresh = met.where("better").select("node", F.col("new").alias("d"))
    return far


def shortest_paths(links: DataFrame, source: str, target: str, k: int = 3, at_once: int = 4096) -> DataFrame:
    """(path, length, support): the k shortest simple paths, a link being one over its weight long; support is the least weight.

    No limit of hops: a path begun can't end shorter than its length and its end's distance to the target, which are
    known beforehand.  The ``at_once`` most promising paths grow by a link at a time; when k have arrived and no open one
    can be shorter, those are the answer.  Ties go by the names along the path; without a way there are no rows.
    """
    spark = links.sparkSession
    out = "path string, length double, support bigint"
    ahead = cut(distances(links, target))
    if source == target or ahead.where(F.col("node") == source).isEmpty():
        return spark.createDataFrame([], out)
    there = links.select(F.col("a").alias("s"), F.col("b").alias("t"), "weight").union(links.select("b", "a", "weight")).where("s <> t")
    steps = cut(there.join(ahead, F.col("t") == F.col("node")).select("s", "t", "weight", F.col("d").alias("ahead")))
    opened = spark.createDataFrame([([source], source, 0.0, None)], "path array<string>, end string, length double, support bigint").join(ahead.withColumnRenamed("node", "end"), "end").select("path", "end", "length", "support", F.col("d").alias("bound"))
    done = opened.where(F.lit(False))
    while True:
        last = opened.orderBy("bound").limit(at_once).agg(F.max("bound")).first()[0]
        if last is None:
            break
        grown = opened.where(F.col("bound") <= last).join(steps, (F.col("end") == F.col("s")) & ~F.array_contains("path", F.col("t"))).select(
            F.concat("path", F.array("t")).alias("path"), F.col("t").alias("end"), (F.col("length") + 1.0 / F.col("weight")).alias("length"), F.least("support", F.col("weight").cast("bigint")).alias("support"), (F.col("length") + 1.0 / F.col("weight") + F.col("ahead")).alias("bound")
        )
        grown = cut(grown)
        done = cut(done.unionByName(grown.where(F.col("end") == target)).orderBy(F.round("length", 9), F.array_join("path", " > ")).limit(k))
        arrived, longest = done.agg(F.count("*"), F.max("length")).first()
        opened = opened.where(F.col("bound") > last).unionByName(grown.where(F.col("end") != target))
        if arrived == k:  # lengths are added up in different orders
            opened = opened.where(F.col("bound") <= longest * (1 + 1e-9))
        opened = cut(opened)
    return done.select(F.array_join("path", " > ").alias("path"), F.round("length", 9).alias("length"), "support").orderBy("length", "path")
