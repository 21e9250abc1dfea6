"""Partitioning a graph into small communities of units (nodes and edges).

Greedy partitioners become rounds: units that come first among their free neighbours seed
communities together, communities propose the free units beside them, a unit takes the best
proposal, and a community takes the first up to its cap.  Each round is a few joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import graph as G
from ..functions import text as T
from .leiden import leiden


def edge_unit(src="src", tgt="tgt") -> Column:
    return F.concat_ws("\u0001", F.least(src, tgt), F.greatest(src, tgt))


def units_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, kind, and those columns of entity_type, loss, length that both have or one has)."""
    cols = [c for c in ("entity_type", "loss", "length") if c in nodes.columns or c in edges.columns]
    kind = {"entity_type": "string", "loss": "double", "length": "long"}
    pick = lambda df: [(F.col(c) if c in df.columns else F.lit(None)).cast(kind[c]).alias(c) for c in cols]
    n = nodes.select(F.col("node_id").alias("unit_id"), F.lit("node").alias("kind"), *pick(nodes))
    return n.unionByName(edges.filter("src <> tgt").select(edge_unit().alias("unit_id"), F.lit("edge").alias("kind"), *pick(edges)))


def incidence(edges: DataFrame) -> DataFrame:
    """(u, v): node and edge units that touch, both ways."""
    e = edges.filter("src <> tgt").select(edge_unit().alias("e"), F.explode(F.array("src", "tgt")).alias("n"))
    return e.select(F.col("e").alias("u"), F.col("n").alias("v")).unionByName(e.select(F.col("n").alias("u"), F.col("e").alias("v"))).distinct()


def order_of(seed: int, loss: str = "random") -> Column:
    """Rank of a unit, smaller first: seeded hash, or loss first (min_loss, max_loss; a missing loss ranks as random)."""
    h = F.xxhash64(F.lit(seed), F.col("unit_id"))
    k = {"random": F.lit(0.0), "min_loss": F.coalesce(F.col("loss"), F.lit(0.0)), "max_loss": -F.coalesce(F.col("loss"), F.lit(0.0))}[loss]
    return F.struct(k.alias("k"), h.alias("h"))


def grow(units: DataFrame, links: DataFrame, cap: int, one_way: bool = False, max_length: int | None = None) -> DataFrame:
    """units(unit_id, kind, rank, can_seed, length) and links(u, v) -> (community_id, unit_id, kind, ord).

    A community has at most cap units, and takes units until the lengths before pass max_length.
    one_way: a node proposes one edge only (a random walk), edges propose both ends.
    """
    spark = units.sparkSession
    units = units.select("unit_id", "kind", "rank", "can_seed", F.coalesce("length", F.lit(0)).alias("length")).transform(G.settled)
    links = G.settled(links)
    out = None
    free = units
    while True:  # each phase uses up the seeds that come first
        rivals = links.join(free.filter("can_seed").select(F.col("unit_id").alias("v"), F.col("rank").alias("vr")), "v").groupBy("u").agg(F.min("vr").alias("best"))
        seeds = free.filter("can_seed").join(rivals, F.col("unit_id") == F.col("u"), "left").filter("best is null or rank < best")
        members = seeds.select(F.col("unit_id").alias("community_id"), "unit_id", "kind", F.lit(0).alias("ord"), F.col("rank").alias("c_rank"), "rank", "length").transform(G.settled)
        if members.isEmpty():
            break
        for step in range(1, cap):
            taken = members.groupBy("community_id").agg(F.count("*").alias("n"), F.sum("length").alias("size"))
            front = members.filter(F.col("ord") == step - 1).join(taken, "community_id").filter(F.col("n") < cap)
            if max_length is not None:
                front = front.filter(F.col("size") <= max_length)
            props = front.select("community_id", "c_rank", "n", "size", F.col("unit_id").alias("u"), F.col("kind").alias("ukind")).join(links, "u").join(free.select(F.col("unit_id").alias("v"), "kind", "rank", "length"), "v")
            props = props.join(members.select(F.col("unit_id").alias("v")), "v", "left_anti")
            if one_way:
                pick = F.row_number().over(Window.partitionBy("u").orderBy("rank"))
                props = props.withColumn("p", F.when(F.col("ukind") == "node", pick).otherwise(1)).filter("p = 1")
            won = props.groupBy("v").agg(F.min_by(F.struct("community_id", "c_rank", "kind", "rank", "length", "n", "size"), F.struct("c_rank", "community_id")).alias("x")).select(F.col("v").alias("unit_id"), "x.*")
            line = Window.partitionBy("community_id").orderBy("rank", "unit_id")
            won = won.withColumns({"place": F.row_number().over(line), "before": F.sum("length").over(line) - F.col("length")}).filter(F.col("n") + F.col("place") <= cap)
            if max_length is not None:
                won = won.filter(F.col("size") + F.col("before") <= max_length)
            won = won.select("community_id", "unit_id", "kind", F.lit(step).alias("ord"), "c_rank", "rank", "length")
            members = G.settled(members.unionByName(won))
            if members.filter(F.col("ord") == step).isEmpty():
                break
        done = members.select("community_id", "unit_id", "kind", "ord")
        out = done if out is None else out.unionByName(done)
        free = free.join(done.select("unit_id"), "unit_id", "left_anti").transform(G.settled)
    return out if out is not None else spark.createDataFrame([], "community_id string, unit_id string, kind string, ord int")


def bfs_communities(nodes: DataFrame, edges: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    units = units_of(nodes, edges)
    if cap == 1:  # every unit by itself
        return units.select(F.col("unit_id").alias("community_id"), "unit_id", "kind", F.lit(0).alias("ord"))
    return grow(_ranked(units, seed), incidence(edges), cap)


def _ranked(units: DataFrame, seed: int, loss: str = "random", can_seed: Column | None = None) -> DataFrame:
    for c, kind in (("loss", "double"), ("length", "long")):
        if c not in units.columns:
            units = units.withColumn(c, F.lit(None).cast(kind))
    return units.withColumns({"rank": order_of(seed, loss), "can_seed": F.lit(True) if can_seed is None else can_seed})


def walk(units: DataFrame, links: DataFrame, cap: int) -> DataFrame:
    """units(unit_id, kind, rank) and links(u, v) -> (community_id, unit_id, kind, ord): depth-first walks.

    A walk holds its stack, the path from its first unit to where it is.  In a step it goes on to the
    first free neighbour (by rank) of the stack's top, or steps back where there is none; it ends at cap
    units or with an empty stack.  Walks from all units that come first among their free neighbours go
    on together; of two that want a unit the one whose first unit ranks first gets it, and the other
    looks again.  Units left over begin further walks.
    """
    free = G.settled(units.select("unit_id", "kind", "rank"))
    links = G.settled(links)
    out = None
    while True:  # each phase uses up the units that come first
        rivals = links.join(free.select(F.col("unit_id").alias("v"), F.col("rank").alias("vr")), "v").groupBy("u").agg(F.min("vr").alias("best"))
        first = free.join(rivals, F.col("unit_id") == F.col("u"), "left").filter("best is null or rank < best")
        members = G.settled(first.select(F.col("unit_id").alias("community_id"), "unit_id", "kind", F.lit(0).alias("ord"), F.col("rank").alias("c_rank")))
        walks = G.settled(members.select("community_id", "c_rank", F.array("unit_id").alias("stack"), F.lit(1).alias("n")))
        if members.isEmpty():
            break
        step = 0
        while cap > 1:
            step += 1
            top = walks.filter((F.size("stack") > 0) & (F.col("n") < cap)).withColumn("u", F.element_at("stack", -1))
            open_ = free.select(F.col("unit_id").alias("v"), "kind", "rank").join(members.select(F.col("unit_id").alias("v")), "v", "left_anti")
            want = top.select("community_id", "c_rank", "u").join(links, "u").join(open_, "v").groupBy("community_id").agg(F.first("c_rank").alias("c_rank"), F.min_by(F.struct("v", "kind"), F.struct("rank", "v")).alias("x"))
            want = want.select("community_id", "c_rank", "x.v", "x.kind")
            won = want.groupBy("v").agg(F.min_by(F.struct("community_id", "kind", "c_rank"), F.struct("c_rank", "community_id")).alias("x")).select("x.community_id", F.col("v").alias("unit_id"), "x.kind", "x.c_rank")
            turn = want.select("community_id", F.lit(True).alias("wants")).join(won.select("community_id", F.col("unit_id").alias("got")), "community_id", "left")
            # the stack: longer by what was won, as it was where another walk won it, shorter where nothing is free
            x = walks.join(turn, "community_id", "left")
            going = (F.size("stack") > 0) & (F.col("n") < cap)
            stack = F.when(F.col("got").isNotNull(), F.array_append("stack", F.col("got"))).when(F.col("wants") | ~going, F.col("stack")).otherwise(F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0))))
            x = G.settled(x.select("community_id", "c_rank", stack.alias("stack"), (F.col("n") + F.col("got").isNotNull().cast("int")).alias("n"), "got"))
            new = x.filter("got is not null").select("community_id", F.col("got").alias("unit_id")).join(free.select("unit_id", "kind"), "unit_id").join(walks.select("community_id", "c_rank"), "community_id")
            members = G.settled(members.unionByName(new.select("community_id", "unit_id", "kind", F.lit(step).alias("ord"), "c_rank")))
            walks = x.select("community_id", "c_rank", "stack", "n")
            if walks.filter((F.size("stack") > 0) & (F.col("n") < cap)).isEmpty():
                break
        done = members.select("community_id", "unit_id", "kind", "ord")
        out = done if out is None else out.unionByName(done)
        free = G.settled(free.join(done.select("unit_id"), "unit_id", "left_anti"))
    return out if out is not None else units.sparkSession.createDataFrame([], "community_id string, unit_id string, kind string, ord int")


def dfs_communities(nodes: DataFrame, edges: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    return walk(_ranked(units_of(nodes, edges), seed), incidence(edges), cap)


def anchored_communities(nodes: DataFrame, edges: DataFrame, cap: int, anchor_type: str | None = None, anchors: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Only nodes whose type contains anchor_type, or of these ids, seed; what they do not reach stays out."""
    ok = F.lower("entity_type").contains(anchor_type.lower()) if anchor_type else F.col("unit_id").isin(anchors or [])
    ok = (F.col("kind") == "node") & F.coalesce(ok, F.lit(False))
    return grow(_ranked(units_of(nodes, edges), seed, can_seed=ok), incidence(edges), cap)


def loss_communities(nodes: DataFrame, edges: DataFrame, cap: int, max_tokens: int, min_units: int = 1, sampling: str = "random", seed: int = 0) -> DataFrame:
    """Seeds and neighbours by loss; a unit and a token budget; communities under min_units go, their units stay used."""
    x = grow(_ranked(units_of(nodes, edges), seed, sampling), incidence(edges), cap, max_length=max_tokens)
    big = x.groupBy("community_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_units).select("community_id")
    return x.join(big, "community_id", "left_semi")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: Newman's modularity of membership(node_id, community_id) over unweighted edges."""
    m = edges.count()
    side = lambda c: membership.select(F.col("node_id").alias(c), F.col("community_id").alias(f"c_{c}"))
    inside = edges.join(side("src"), "src").join(side("tgt"), "tgt").filter("c_src = c_tgt").agg((F.count("*") / m).alias("inside"))
    total = G.degrees(edges).join(membership, "node_id").groupBy("community_id").agg(F.sum("degree").alias("k")).agg(F.sum((F.col("k") / (2 * m)) ** 2).alias("chance"))
    return inside.crossJoin(total).select((F.col("inside") - F.col("chance")).alias("modularity"))  # one row each


def modularity_communities(nodes: DataFrame, edges: DataFrame, max_size: int | None = None, use_lcc: bool = False, seed: int = 0) -> DataFrame:
    """(community_id, node_id): connected communities of high modularity; see leiden.py.

    Isolated nodes and self-loops are left out; communities over max_size are cut into slices.
    use_lcc: of the largest component only.
    """
    e = edges.filter("src <> tgt").select("src", "tgt").distinct()
    if use_lcc:
        keep = G.connected_components(e)
        top = keep.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
        keep = keep.join(F.broadcast(top), "component").select(F.col("node").alias("src"))  # one row
        e = e.join(keep, "src", "left_semi")
    out = leiden(e, seed=seed).select("community_id", "node_id")
    return sliced(out, max_size) if max_size else out


def sliced(membership: DataFrame, max_size: int) -> DataFrame:
    """Communities over max_size as consecutive slices by node id."""
    part = F.floor((F.row_number().over(Window.partitionBy("community_id").orderBy("node_id")) - 1) / max_size)
    return membership.withColumn("slice", part).select(F.concat_ws("#", "community_id", F.col("slice").cast("string")).alias("community_id"), "node_id")


# Hierarchies: directed edges child -> parent

RELATIONS = ("is_a", "subclass_of", "part_of", "includes", "type_of")


def hierarchy_edges(edges: DataFrame, relations=RELATIONS) -> DataFrame:
    """Adds is_hierarchy by relation_type, else description."""
    kinds = [F.col(c) for c in ("relation_type", "description") if c in edges.columns]
    return edges.withColumn("is_hierarchy", F.coalesce(*kinds, F.lit("")).isin(*relations))


def sibling_groups(edges: DataFrame, max_siblings: int = 10) -> DataFrame:
    """edges(src child, tgt parent) -> (community_id, node_id, role): a parent and two or more of its children.

    A child belongs to the parent with most free children (ties: the smaller id); a group takes
    max_siblings, and what is left over forms further groups of the parent while two remain.  Children
    that are alone in a group try their other parents, until a round changes nothing.
    """
    G.ensure_checkpoint_dir(edges.sparkSession)
    free = edges.filter("src <> tgt").select("src", "tgt").distinct()
    x, again, left = None, "", free.count()
    while True:  # each round but the last takes edges away
        sizes = free.groupBy("tgt").agg(F.count("*").alias("n"))
        claim = free.join(sizes, "tgt").groupBy("src").agg(F.min_by("tgt", F.struct(-F.col("n"), F.col("tgt"))).alias("parent"), F.count("*").alias("parents"))
        claim = G.numbered(claim, "parent", "src")  # places by range: a parent of many children is no task of its own
        claim = claim.join(claim.groupBy("parent").agg(F.min("_place").alias("_first")), "parent")
        claim = claim.withColumn("g", F.floor((F.col("_place") - F.col("_first")) / max_siblings)).drop("_place", "_first")
        claim = claim.join(claim.groupBy("parent", "g").agg(F.count("*").alias("n")), ["parent", "g"])
        claim = G.settled(claim.withColumn("community_id", F.concat(F.col("parent"), F.lit("/" + again), F.col("g").cast("string"))))
        found = claim.filter("n >= 2")
        x, again = found if x is None else x.unionByName(found), again + "+"
        alone = claim.filter("n < 2 and parents > 1").select("src", F.col("parent").alias("tgt"))
        free = free.join(found.select("src"), "src", "left_anti").join(alone, ["src", "tgt"], "left_anti").transform(G.settled)
        before, left = left, free.count()
        if left in (0, before):
            break
    heads = x.select("community_id", F.col("parent").alias("node_id"), F.lit("parent").alias("role")).distinct()
    return x.select("community_id", F.col("src").alias("node_id"), F.lit("child").alias("role")).unionByName(heads)


def vertical_chains(edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """edges(src child, tgt parent) -> (community_id, node_id, depth): paths down from roots, one per last node; a node keeps its first path."""
    e = edges.filter("src <> tgt").select("src", "tgt").distinct()
    roots = e.select(F.col("tgt").alias("node_id")).distinct().join(e.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    level = roots.select("node_id", F.array("node_id").alias("path"))
    ends = None
    for depth in range(1, max_depth + 1):
        down = level.join(e, level["node_id"] == e["tgt"]).filter(~F.array_contains("path", F.col("src"))).select(F.col("src").alias("node_id"), F.array_append("path", F.col("src")).alias("path"))
        stuck = level.join(e.select(F.col("tgt").alias("node_id")).distinct(), "node_id", "left_anti")
        ends = stuck if ends is None else ends.unionByName(stuck)
        level = down
    ends = ends.unionByName(level).filter(F.size("path") > 1)
    x = ends.select(F.array_join("path", ">").alias("community_id"), F.posexplode("path").alias("depth", "node_id"))
    return x.groupBy("node_id").agg(F.min_by(F.struct("community_id", "depth"), "community_id").alias("x")).select("x.community_id", "node_id", "x.depth")


def leftovers(nodes: DataFrame, edges: DataFrame, used: DataFrame) -> DataFrame:
    """Single-node communities of unused nodes: (community_id, node_id, has_edges)."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node_id")).distinct().withColumn("has_edges", F.lit(True))
    x = nodes.select("node_id").join(used.select("node_id"), "node_id", "left_anti").join(ends, "node_id", "left")
    return x.select(F.col("node_id").alias("community_id"), "node_id", F.coalesce("has_edges", F.lit(False)).alias("has_edges"))


# Batches


def or_fallback(membership: DataFrame, nodes: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """membership, or where it is empty one community of all nodes (if their tokens fit) or one per node."""
    if not membership.isEmpty():
        return membership
    unit = nodes.select("node_id", F.coalesce("length", F.lit(100)).alias("length") if "length" in nodes.columns else F.lit(100).alias("length"))
    whole = max_tokens is not None and (unit.agg(F.sum("length")).first()[0] or 0) <= max_tokens
    return unit.select((F.lit("all") if whole else F.col("node_id")).alias("community_id"), F.col("node_id").alias("unit_id"), F.lit("node").alias("kind"), F.lit(0).alias("ord"))


def batches(membership: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(batch_id, nodes array<struct>, edges array<struct>) with the data of each unit; missing units go."""
    n = membership.filter("kind = 'node'").join(nodes, F.col("unit_id") == F.col("node_id")).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "description"))).alias("nodes"))
    e = membership.filter("kind = 'edge'").join(edges.withColumn("_u", edge_unit()), F.col("unit_id") == F.col("_u")).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("src", "tgt", "description"))).alias("edges"))
    out = n.join(e, "community_id", "full")
    return out.select(F.col("community_id").alias("batch_id"), F.coalesce("nodes", F.array().cast(n.schema["nodes"].dataType)).alias("nodes"), F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))


def with_image(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """images(chunk_id, img_path, caption) joined to nodes by the unquoted, lower-cased id."""
    key = F.lower(F.trim(F.regexp_replace("node_id", "^\"+|\"+$", "")))
    return nodes.withColumn("_k", key).join(images.withColumnRenamed("chunk_id", "_k"), "_k", "left").drop("_k")


def with_lengths(table: DataFrame) -> DataFrame:
    """Fills length, where it is missing, with the token estimate of the description."""
    have = F.col("length") if "length" in table.columns else F.lit(None).cast("long")
    return table.withColumn("length", F.coalesce(have, T.token_estimate("description")))
