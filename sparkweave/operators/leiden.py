"""Communities of high modularity by levels of moving, refining and contracting (Leiden).

A level moves nodes between communities until modularity stands, splits each community into
refined parts that hang together, and contracts every part into one node of the next level; the
weight inside a part becomes its loop.  The communities of a level are where the next one starts.
Levels end when nothing contracts or modularity
rises by no more than `tolerance`.  Every step is a few joins and grouped
sums over (node, neighbour, weight), so a level costs what its links cost, and levels shrink.

Moves of a round are made together.  A wide round moves about half of the nodes that gain (by a hash of
node and round); where that no longer helps, a narrow round moves at most one node out of or into
each community, so that every gain is exact and modularity rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import graph as G

_LEAST = 1e-9


def links_of(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(u, v, w) both ways, loops left out; parallel edges add up by weight, or are one edge without it."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.filter("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), w.alias("w"))
    e = e.groupBy("src", "tgt").agg((F.sum if weight else F.max)("w").alias("w")).filter("w > 0")
    return e.select(F.col("src").alias("u"), F.col("tgt").alias("v"), "w").unionByName(e.select(F.col("tgt").alias("u"), F.col("src").alias("v"), "w"))


def _coin(seed: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(2)) == 0


def _proposals(links: DataFrame, state: DataFrame, two_m: float, resolution: float, seed: int) -> DataFrame:
    """state(id, k, loop, c) with best, delta (the gain in modularity of going there, at least 0), w_own and sum_k of its community."""
    total = state.groupBy("c").agg(F.sum("k").alias("sum_k"))
    toward = links.join(state.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id"), "c").agg(F.sum("w").alias("w"))
    toward = toward.unionByName(state.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
    x = toward.join(total, "c").join(state.select("id", "k", F.col("c").alias("now")), "id")
    own = F.col("c") == F.col("now")
    gain = F.col("w") - resolution * F.col("k") * (F.col("sum_k") - F.when(own, F.col("k")).otherwise(0.0)) / two_m
    x = x.withColumns({"own": own, "gain": gain})
    best = x.groupBy("id").agg(
        F.max_by("c", F.struct("gain", F.xxhash64(F.lit(seed), "c"))).alias("best"), F.max("gain").alias("top"),
        F.max(F.when(F.col("own"), F.col("gain"))).alias("mine"), F.max(F.when(F.col("own"), F.col("w"))).alias("w_own"), F.max(F.when(F.col("own"), F.col("sum_k"))).alias("sum_k"),
    )
    delta = 2 * (F.col("top") - F.col("mine")) / two_m
    return state.join(best, "id").select("id", "k", "loop", "c", F.when(delta > _LEAST, F.col("best")).otherwise(F.col("c")).alias("best"), F.when(delta > _LEAST, delta).otherwise(0.0).alias("delta"), "w_own", "sum_k")


def _quality(x: DataFrame, two_m: float, resolution: float) -> tuple[float, int]:
    """(modularity, nodes that would gain by moving) of proposals."""
    # a community's (sum_k / 2m)^2 is the sum of k * sum_k over its nodes
    r = x.agg(F.sum(F.col("w_own") + F.col("loop")).alias("inside"), F.sum(F.col("k") * F.col("sum_k")).alias("chance"), F.count_if(F.col("delta") > 0).alias("movers")).first()
    return (r["inside"] or 0.0) / two_m - resolution * (r["chance"] or 0.0) / two_m**2, r["movers"]


def _moved(links: DataFrame, state: DataFrame, two_m: float, resolution: float, tolerance: float, seed: int) -> tuple[DataFrame, float]:
    """state after local moving, and its modularity, which is not below that of the state given."""
    best, best_q, narrow, turn = state, None, False, 0
    while True:
        turn += 1
        x = _proposals(links, state, two_m, resolution, seed + turn).transform(G.settled)
        q, movers = _quality(x, two_m, resolution)
        gained = best_q is None or q > best_q + tolerance
        if best_q is None or q > best_q:
            best, best_q = x, q
        if not movers or (narrow and not gained):
            return best.select("id", "k", "loop", "c"), best_q
        if not gained:  # wide rounds no longer help: go on from the best state, one move a community
            narrow, x = True, best
        if narrow:
            ends = x.filter("delta > 0").select("id", F.col("delta"), F.explode(F.array("c", "best")).alias("end"))
            first = ends.groupBy("end").agg(F.max_by("id", F.struct("delta", "id")).alias("id"))
            go = first.groupBy("id").agg(F.count("*").alias("n")).filter("n = 2").select("id", F.lit(True).alias("go"))
            x = x.join(go, "id", "left").withColumn("go", F.coalesce("go", F.lit(False)))
        else:
            x = x.withColumn("go", _coin(seed + 31 * turn, "id"))
        state = x.select("id", "k", "loop", F.when(F.col("go"), F.col("best")).otherwise(F.col("c")).alias("c"))


def _refined(links: DataFrame, state: DataFrame, two_m: float, resolution: float, seed: int) -> DataFrame:
    """(id, part): connected parts of each community, grown from single nodes.

    Only a node that is alone in its part joins another, across a link, with a gain, and only a part that
    stands in this round (its own nodes show the other side of the coin or are more than one); so a
    part never loses the node that holds it together.  Nodes and parts must be well connected to the
    rest of their community.
    """
    inner = links.join(state.select(F.col("id").alias("u"), "c"), "u").join(state.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").filter("c = cv").select("u", "v", "w").transform(G.settled)
    total = state.groupBy("c").agg(F.sum("k").alias("of_c"))
    at = state.join(total, "c").select("id", "k", "of_c", F.col("id").alias("part")).transform(G.settled)
    turn = 0
    while True:
        turn += 1
        across = inner.join(at.select(F.col("id").alias("u"), F.col("part").alias("pu")), "u").join(at.select(F.col("id").alias("v"), F.col("part").alias("pv")), "v").filter("pu <> pv")
        outer = across.groupBy("pu").agg(F.sum("w").alias("out"))
        parts = at.groupBy("part").agg(F.sum("k").alias("pk"), F.count("*").alias("n"), F.max("of_c").alias("of_c"))
        parts = parts.join(outer.withColumnRenamed("pu", "part"), "part").filter(F.col("out") >= resolution * F.col("pk") * (F.col("of_c") - F.col("pk")) / two_m - 1e-12)
        parts = parts.select("part", "pk", "n", _coin(seed + turn, "part").alias("head"))
        toward = across.groupBy("pu", "pv").agg(F.sum("w").alias("w"))
        x = toward.join(parts.filter("n = 1").select(F.col("part").alias("pu"), F.col("pk").alias("ku"), F.col("head").alias("hu")), "pu")
        x = x.join(parts.select(F.col("part").alias("pv"), "pk", "n", F.col("head").alias("hv")), "pv")
        x = x.withColumn("gain", F.col("w") - resolution * F.col("ku") * F.col("pk") / two_m).filter(F.col("gain") > _LEAST)
        x = x.withColumn("now", F.col("hu") & ((F.col("n") > 1) | ~F.col("hv"))).transform(G.settled)
        if x.isEmpty():
            return at.select("id", "part")
        join = x.filter("now").groupBy(F.col("pu").alias("part")).agg(F.max_by("pv", F.struct("gain", "pv")).alias("to"))
        at = at.join(join, "part", "left").select("id", "k", "of_c", F.coalesce("to", "part").alias("part")).transform(G.settled)


def leiden(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, tolerance: float = 1e-3, seed: int = 0) -> DataFrame:
    """(node_id, community_id) for every node of an edge (src, tgt); a community is named by its smallest node.

    Communities are connected.  The result depends on the edges and the seed alone.  Loops and
    isolated nodes are left out.
    """
    G.ensure_checkpoint_dir(edges.sparkSession)
    first = links_of(edges, weight).transform(G.settled)
    two_m = first.agg(F.sum("w")).first()[0]
    if not two_m:
        return edges.sparkSession.createDataFrame([], "node_id string, community_id string")
    degree = first.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    base = degree.select("id", "k", F.lit(0.0).alias("loop")).transform(G.settled)
    member, start, last = None, base.withColumn("c", F.col("id")), None
    while True:  # each turn begins from the single nodes again, in the communities found so far
        links, state, place = first, start, base.select(F.col("id").alias("node_id"), "id").transform(G.settled)
        before = None
        while True:  # levels
            state, q = _moved(links, state, two_m, resolution, tolerance, seed)
            state = state.transform(G.settled)
            n = state.count()
            found = place.join(state.select("id", "c"), "id").select("node_id", F.col("c").alias("community_id"))
            if last is not None and before is None and q <= last + tolerance:
                return member  # single nodes gain nothing by leaving
            if n == 1 or (before is not None and q <= before + tolerance):
                break
            before = q
            part = _refined(links, state, two_m, resolution, seed).transform(G.settled)
            if part.select("part").distinct().count() == n:
                break
            links, state, place = _contracted(links, state, part, place)
        if last is not None and q <= last + tolerance:
            break
        member, last = _connected(first, found).transform(G.settled), q
        start = base.join(member.select(F.col("node_id").alias("id"), F.col("community_id").alias("c")), "id").transform(G.settled)
    return member


def _contracted(links: DataFrame, state: DataFrame, part: DataFrame, place: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next level: each part is a node, in the community of its nodes, with the links of its nodes added up."""
    side = lambda c: part.select(F.col("id").alias(c), F.col("part").alias(f"p{c}"))
    whole = links.join(side("u"), "u").join(side("v"), "v").groupBy("pu", "pv").agg(F.sum("w").alias("w")).transform(G.settled)
    loops = whole.filter("pu = pv").select(F.col("pu").alias("part"), F.col("w").alias("within"))
    x = state.join(part, "id").groupBy("part").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.first("c").alias("c")).join(loops, "part", "left")
    x = x.select(F.col("part").alias("id"), "k", (F.col("loop") + F.coalesce("within", F.lit(0.0))).alias("loop"), "c").transform(G.settled)
    return whole.filter("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"), "w"), x, place.join(part, "id").select("node_id", F.col("part").alias("id")).transform(G.settled)


def _connected(links: DataFrame, found: DataFrame) -> DataFrame:
    """found(node_id, community_id) cut into connected parts, which never lowers modularity, named by their smallest nodes."""
    side = lambda c: found.select(F.col("node_id").alias(c), F.col("community_id").alias(f"c_{c}"))
    inside = links.filter("u < v").join(side("u"), "u").join(side("v"), "v").filter("c_u = c_v")
    parts = G.connected_components(inside, "u", "v").select(F.col("node").alias("node_id"), F.col("component").alias("community_id"))
    alone = found.select("node_id").join(parts, "node_id", "left_anti").select("node_id", F.col("node_id").alias("community_id"))
    return parts.unionByName(alone)
