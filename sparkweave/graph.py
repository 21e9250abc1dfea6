"""Graph tables: nodes(node_id, ...), edges(src, tgt, ...); access, components, hops, paths."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F


#: Steps that a search may list at once however few edges there are.
ROOM = 1 << 22

#: Bytes of files up to which a settled table may be broadcast in a join.
SMALL = 1 << 20


def ensure_checkpoint_dir(spark) -> None:
    """Use the cluster's spark.checkpoint.dir; only in local mode (tests) may a folder of our own stand in."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back.

    Cuts the lineage as checkpoint() does, but the plan then knows the table's size; after checkpoint()
    it keeps the estimate of the old plan, which multiplies with every join of a loop.  A table of more than
    SMALL bytes is not broadcast in joins: a loop would send it to the driver once a round.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out if _small(out) else out.hint("merge")


def _small(df: DataFrame) -> bool:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL


def dropped(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def lean(spark):
    """Shuffle files go when the statement that wrote them has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _place, from 0 in this order: sorted by range, numbered within ranges, the ranges' sizes added up."""
    from pyspark.sql import Window

    cuts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = cuts.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = cuts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(sizes), "_p")
    return x.withColumn("_place", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def _hooked(e: DataFrame) -> DataFrame:
    """(node, to) of all nodes of e(u, v): each points to its neighbour of greatest rank, or to itself where it outranks them, followed to the end.

    Ranks are hashes, so chains are short.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    best = e.select("u", rank("v").alias("r")).unionByName(e.select(F.col("v").alias("u"), rank("u").alias("r"))).groupBy("u").agg(F.max("r").alias("r"))
    state = settled(best.select(F.col("u").alias("node"), F.greatest("r", rank("u"))["n"].alias("to")))
    while True:
        last = state
        state = settled(state.join(state.select(F.col("node").alias("to"), F.col("to").alias("to2")), "to").select("node", F.col("to2").alias("to"), (F.col("to") != F.col("to2")).alias("moved")))
        dropped(last)
        moved, state = state.filter("moved"), state.select("node", "to")
        if moved.isEmpty():
            return state


def connected_components(edges: DataFrame, src: str = "src", tgt: str = "tgt", plain: bool = False) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nodes are first hooked to a neighbour each, which leaves few edges of a dense graph; large-star and
    small-star (Kiveris et al. 2014) then alternate until the edges are stars; each round is
    checkpointed.  Nulls and self-loops are ignored.  Plain edges are settled and hold neither, so no copy is made.
    """
    e = edges.select(F.greatest(src, tgt).alias("u"), F.least(src, tgt).alias("v"))
    e = e if plain else settled(e.filter("u is not null and v is not null and u <> v"))
    at = _hooked(e)
    side = lambda c: at.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
    whole, e = e, settled(e.join(side("u"), "u").join(side("v"), "v").filter("_u <> _v").select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
    if not plain:
        dropped(whole)
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(last)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select("v", F.lit(0), F.lit(1)).toDF("x", "up", "root"))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up = 1 and root = 1)").isEmpty():
            break  # stars: every node points to one root, and no root points on
    whole = settled(at.join(e.select(F.col("u").alias("to"), F.col("v").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    dropped(at, e)
    return whole.join(whole.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as (u, v) and (v, u)."""
    return edges.select(F.col("src").alias("u"), F.col("tgt").alias("v")).unionByName(edges.select(F.col("tgt").alias("u"), F.col("src").alias("v")))


def find_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(src, tgt) with the edge's columns in either orientation; null where there is none."""
    key = lambda df: df.withColumns({"_a": F.least("src", "tgt"), "_b": F.greatest("src", "tgt")})
    return key(pairs).join(key(edges).drop("src", "tgt"), ["_a", "_b"], "left").drop("_a", "_b")


def node_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, neighbour) for the wanted nodes."""
    return both_ways(edges).withColumnRenamed("u", "node_id").join(nodes.select("node_id"), "node_id", "left_semi").withColumnRenamed("v", "neighbour")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    x = edges.join(d.withColumnsRenamed({"node_id": "src", "degree": "_s"}), "src").join(d.withColumnsRenamed({"node_id": "tgt", "degree": "_t"}), "tgt")
    return x.select("src", "tgt", (F.col("_s") + F.col("_t")).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node_id")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


def induced_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """membership(community_id, node_id) -> (community_id, src, tgt): edges with both ends in one community."""
    m = membership.select("community_id", F.col("node_id").alias("src"))
    x = edges.join(m, "src")
    return x.join(membership.select("community_id", F.col("node_id").alias("tgt")), ["community_id", "tgt"], "left_semi").select("community_id", "src", "tgt")


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest component with ids upper-cased and trimmed (ties: the smaller component id)."""
    c = connected_components(edges)
    alone = nodes.select(F.col("node_id").alias("node")).join(c, "node", "left_anti").withColumn("component", F.col("node"))
    c = c.unionByName(alone)
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    keep = c.join(F.broadcast(top), "component").select(F.col("node").alias("node_id"))  # one row
    name = lambda x: F.upper(F.trim(x))
    out = edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return nodes.join(keep, "node_id", "left_semi").withColumn("node_id", name("node_id")), out.withColumns({"src": name("src"), "tgt": name("tgt")})


def k_hop(edges: DataFrame, seeds: DataFrame, max_hops: int, max_nodes: int, group: str = "intent_id") -> tuple[DataFrame, DataFrame]:
    """Breadth-first growth of every group's seeds at once.

    seeds(group, node_id) -> (nodes(group, node_id, hop), edges(group, src, tgt)).  A group keeps
    max_nodes nodes, nearer ones first, then by id; edges join two kept nodes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    from pyspark.sql import Window

    step = both_ways(edges).distinct()
    rank = Window.partitionBy(group).orderBy("hop", "node_id")
    cut = lambda df: df.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= max_nodes).drop("_r")
    seen = cut(seeds.select(group, "node_id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, max_hops + 1):
        front = seen.filter(F.col("hop") == hop - 1)
        new = front.join(step, front["node_id"] == step["u"]).select(group, F.col("v").alias("node_id")).distinct()
        new = new.join(seen, [group, "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = cut(seen.unionByName(new)).checkpoint()
    x = edges.select("src", "tgt").join(seen.select(group, F.col("node_id").alias("src")), "src")
    x = x.join(seen.select(group, F.col("node_id").alias("tgt")), [group, "tgt"], "left_semi")
    return seen, x.select(group, "src", "tgt")


def first_nodes(nodes: DataFrame, edges: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and the edges among them."""
    keep = nodes.orderBy("node_id").limit(max_nodes)
    for end in ("src", "tgt"):
        edges = edges.join(keep.select(F.col("node_id").alias(end)), end, "left_semi")
    return keep, edges.select("src", "tgt")


def path_lengths(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(source, node_id, hops) for every node within max_hops of each source.

    Edges are taken both ways and read once a hop, so a computed table is best settled() before; repeated edges
    change nothing.  A hop leads one ring in, along or out: new nodes are held against the last two rings only.
    """
    step = both_ways(edges)
    inner = None
    ring = seen = settled(sources.select(F.col("node_id").alias("source"), "node_id").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, max_hops + 1):
        new = ring.join(step, ring["node_id"] == step["u"]).select("source", F.col("v").alias("node_id")).distinct()
        near = ring if inner is None else ring.unionByName(inner)
        inner, ring = ring, settled(new.join(near, ["source", "node_id"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(ring)
    return seen


def _farthest(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, top): of all nodes from which steps(u, v) lead to a node, itself included, the one of greatest rank.

    Ranks are hashes, so that no order of ids makes long chains of small gains; besides its neighbours'
    best a node takes the best of its own best, which doubles the distance that a rank travels.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    best = settled(nodes.select("node", rank("node").alias("top")))
    while True:
        near = steps.join(best.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "top", F.lit(None).cast(best.schema["top"].dataType).alias("old"))
        near = best.withColumn("old", F.col("top")).unionByName(near).groupBy("node").agg(F.max("top").alias("top"), F.max("old").alias("old"))
        ahead = best.select(F.col("node").alias("_n"), F.col("top").alias("_t"))
        new = near.join(ahead, F.col("top.n") == F.col("_n"), "left").withColumn("top", F.greatest("top", "_t"))
        new = settled(new.select("node", "top", (F.col("top") > F.col("old")).alias("moved")))
        best = new.select("node", "top")
        if new.filter("moved").isEmpty():
            return best.select("node", F.col("top.n").alias("top"))


def _followed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycles(node, component), what is left of edges(src, tgt)): cycles of nodes with one way out each, and what leads to them only.

    Ways out are followed by doubling: after k rounds a way is 2^k edges long, and only nodes that such a way
    leads to stay, so tails and ends drop out in the logarithm of their length and rounds shrink.  When none
    drops out, the ways permute what is left, which is the cycles.
    """
    one = settled(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("tgt").alias("to")).filter("n = 1").select(F.col("src").alias("node"), "to"))
    at, n = one, one.count()
    while n:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        at = settled(at.join(at.select(F.col("to").alias("node")).distinct(), "node", "left_semi").join(ahead, "to").select("node", F.col("to2").alias("to")))
        before, n = n, at.count()
        if n == before:
            break
    low = settled(one.join(at.select("node"), "node", "left_semi").withColumn("low", F.least("node", "to")))
    while n:  # the smallest node of 2^k steps on
        ahead = low.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        low = settled(low.join(ahead, "to").select("node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        moved, low = low.filter("moved"), low.select("node", "to", "low")
        if moved.isEmpty():
            break
    # the other nodes with one way out: where do they lead?
    way = one.join(low.select("node"), "node", "left_anti")
    way = settled(way.join(way.select(F.col("node").alias("to"), F.lit(True).alias("open")), "to", "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open")))
    while not way.filter("open").isEmpty():
        ahead = way.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("open").alias("open2"))
        way = settled(way.filter("not open").unionByName(way.filter("open").join(ahead, "to").select("node", F.col("to2").alias("to"), F.col("open2").alias("open"))))
    many = edges.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("src").alias("to"))
    gone = settled(low.select("node").unionByName(way.join(many, "to", "left_anti").select("node")))
    for end in ("src", "tgt"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return low.select("node", F.col("low").alias("component")), edges.select("src", "tgt")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on a directed cycle of edges(src, tgt): its strongly connected component, by its smallest node.

    Cycles whose nodes have one way out, or one way in, are found by following them (_followed).  For the
    rest, forward and backward colouring: each node takes the colour of the first-ranked node that leads
    to it; a colour's node and what leads back to it within the colour are one component.  They go, edges
    between colours go, and what is left is coloured again.  A loop is a cycle; nulls are ignored.
    """
    whole = settled(edges.select("src", "tgt").filter("src is not null and tgt is not null").distinct())
    left, out = whole.filter("src <> tgt"), None
    ring, left = _followed(left)
    back, left = _followed(settled(left.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))))
    ring, left = ring.unionByName(back), left.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    while True:
        left = settled(left)
        n, before = left.count(), None
        while n and (before is None or n < 0.95 * before):  # nodes without a way in or out are on no cycle; long chains are left to the colours
            inner = left.join(left.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi")
            left, before = settled(inner.select("src", "tgt")), n
            n = left.count()
        if not n:
            break
        nodes = left.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
        colour = settled(_farthest(left.select(F.col("src").alias("u"), F.col("tgt").alias("v")), nodes))
        side = lambda c: colour.select(F.col("node").alias(c), F.col("top").alias(f"c_{c}"))
        inside = settled(left.join(side("src"), "src").join(side("tgt"), "tgt").filter("c_src = c_tgt").select("src", "tgt"))
        back = _farthest(inside.select(F.col("tgt").alias("u"), F.col("src").alias("v")), nodes)
        found = settled(colour.join(back.withColumnRenamed("top", "b"), "node").filter("b = top").select("node", "top"))
        out = found if out is None else out.unionByName(found)
        for end in ("src", "tgt"):
            inside = inside.join(found.select(F.col("node").alias(end)), end, "left_anti")
        left = inside.select("src", "tgt")
    if out is not None:
        names = out.groupBy("top").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
        ring = ring.unionByName(out.join(names, "top").select("node", "component"))
    ring = settled(ring)
    loops = whole.filter("src = tgt").select(F.col("src").alias("node"))
    return ring.unionByName(loops.join(ring, "node", "left_anti").select("node", F.col("node").alias("component")))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """(src, tgt, component): the directed edges that lie on a cycle, loops included; edges between cycles do not."""
    c = settled(strong_components(edges))
    side = lambda x: c.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    e = edges.select("src", "tgt").distinct()
    return e.join(side("src"), "src").join(side("tgt"), "tgt").filter("c_src = c_tgt").select("src", "tgt", F.col("c_src").alias("component"))


def cycle_core(edges: DataFrame) -> DataFrame:
    """(src, tgt) of cycle_edges()."""
    return cycle_edges(edges).select("src", "tgt")


def without_cycles(edges: DataFrame) -> DataFrame:
    """Directed edges with one edge per cyclic component dropped (the greatest), again until no cycle is left."""
    out = edges
    while True:
        core = settled(cycle_edges(out))
        if core.isEmpty():
            return out
        drop = core.groupBy("component").agg(F.max(F.struct("src", "tgt")).alias("x")).select("x.src", "x.tgt")
        drop = drop.unionByName(core.filter("src = tgt").select("src", "tgt")).distinct()
        out = settled(out.join(drop, ["src", "tgt"], "left_anti"))


def _by_smaller_ring(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """(end listed, other end, (source, target, node)): each pair with the nodes of the smaller of its two rings(end, node)."""
    ring = {"source": sources, "target": targets}
    sized = lambda e: ring[e].groupBy(F.col("end").alias(e)).agg(F.count("*").alias(f"n_{e}"))
    near = pairs.join(sized("source"), "source").join(sized("target"), "target")
    listed = lambda e, which: near.filter(which).select("source", "target").join(ring[e].withColumnRenamed("end", e), e)
    return [("source", "target", listed("source", "n_source <= n_target")), ("target", "source", listed("target", "n_source > n_target"))]


def _met(pairs: DataFrame, ring: dict[str, DataFrame]) -> DataFrame:
    """(source, target) of the pairs whose two rings(end, node) share a node; one listing after the other, as each moves both rings."""
    hits = []
    for e, o, some in _by_smaller_ring(pairs, ring["source"], ring["target"]):
        hits.append(settled(some.join(ring[o].withColumnRenamed("end", o), [o, "node"], "left_semi").select("source", "target").distinct()))
    return hits[0].unionByName(hits[1])  # a pair is in one listing


class _Rings:
    """Rings around both ends of open pairs(source, target), grown until they meet: the search of pair_distances()."""

    def __init__(self, ways: dict, degree: DataFrame, pairs: DataFrame, at: dict, room: int):
        self.ways, self.degree, self.open, self.at, self.room = ways, degree, pairs, at, room
        self.ring = {e: settled(pairs.select(F.col(e).alias("end"), F.col(e).alias("node")).distinct()) for e in at}
        self.inner: dict = {e: None for e in at}  # the ring before: a hop leads one ring in, along or out
        self.ahead: dict = {e: None for e in at}
        self.mine = [*self.ring.values()]

    def part(self, pairs: DataFrame) -> _Rings:
        """The same for some of the pairs; it leaves this one's tables alone."""
        x = object.__new__(_Rings)
        x.__dict__ = self.__dict__ | {"open": settled(pairs), "mine": []} | {k: dict(getattr(self, k)) for k in ("at", "ring", "inner", "ahead")}
        x.mine.append(x.open)
        return x

    def keep(self, df: DataFrame) -> DataFrame:
        self.mine.append(out := settled(df))
        return out

    def free(self, *tables: DataFrame) -> None:
        dropped(*(x for x in self.mine if any(x is y for y in tables)))
        self.mine = [x for x in self.mine if not any(x is y for y in tables)]

    def ends(self, e: str) -> DataFrame:
        return self.open.select(F.col(e).alias("end")).distinct()

    def costs(self) -> dict[str, int]:
        """Steps that lead on from either side's rings, of ends of open pairs."""
        for e, r in self.ring.items():
            if self.ahead[e] is None:
                self.ahead[e] = self.keep(r.join(self.degree, r["node"] == self.degree["u"]).groupBy("end").agg(F.sum("n").alias("n")))
        return {e: self.ahead[e].join(self.ends(e), "end", "left_semi").agg(F.sum("n")).first()[0] or 0 for e in self.ring}

    def beyond(self, e: str, ring: DataFrame) -> DataFrame:
        """(end, node) one step from ring's nodes; may repeat."""
        front = ring.join(self.ends(e), "end", "left_semi")
        return (F.broadcast(front) if _small(ring) else front).join(self.ways[self.at[e]], F.col("node") == F.col("u")).select("end", F.col("v").alias("node"))

    def grow(self, e: str) -> None:
        new = self.beyond(e, self.ring[e])
        if not self.at[e] or self.inner[e] is not None:  # else the first ring between two sides, each edge once
            near = self.ring[e] if self.inner[e] is None else self.ring[e].unionByName(self.inner[e])
            new = new.distinct().join(near, ["end", "node"], "left_anti")
        new = self.keep(new)
        self.free(self.inner[e], self.ahead[e])
        self.inner[e], self.ring[e], self.ahead[e] = self.ring[e], new, None
        self.at[e] = -self.at[e]

    def close(self, met: DataFrame) -> None:
        before, self.open = self.open, self.keep(self.open.join(met, ["source", "target"], "left_anti"))
        self.free(before)

    def some_met(self, sides: list[str], lo: float, share: dict[str, float]) -> DataFrame:
        """Open pairs that meet one step beyond slices of the rings of these sides: by a share of each ring's nodes, by hash."""
        place = F.pmod(F.xxhash64("end", "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = {e: settled(self.beyond(e, self.ring[e].filter((place >= lo) & (place < lo + share[e]))).distinct()) for e in sides}
        met = _met(self.open, self.ring | some)
        dropped(*some.values())
        return met

    def search(self, hops: int, left: int, stride: int, max_hops: int, fits: bool = False) -> list[DataFrame]:
        """(source, target, hops) of open pairs that are hops, hops + stride, ... apart; left growths come before the next meeting.

        A growth of more than room steps is not made as such.  First, pairs are looked for that meet by slices of room
        steps, as most pairs of a dense graph do: nearer meetings being out, any common node gives the distance.  What is
        left is grown whole, in batches of pairs that have room.
        """
        found = []
        while hops <= max_hops:
            while left:
                if self.open.isEmpty() or not min((cost := self.costs()).values()):
                    self.free(*self.mine)
                    return found  # no pair is open, or one side has nowhere to go
                side = min(cost, key=lambda e: (cost[e], e))
                lo = 0.0
                while not fits and cost[side] > self.room:
                    n = self.open.count()
                    share = {e: self.room / max(c, self.room) for e, c in cost.items()}
                    met = self.some_met([side] if left == 1 else list(cost), lo, share)
                    found.append(met.withColumn("hops", F.lit(hops)))
                    self.close(met)
                    lo = lo + share[side] if lo + share[side] < 1 else 0.0
                    cost = self.costs()
                    if 10 * self.open.count() > 9 * n:
                        break
                if not fits and cost[side] > self.room:
                    n = math.ceil(cost[side] / self.room)
                    for k in range(n):
                        batch = self.part(self.open.filter(F.pmod(F.xxhash64(side), F.lit(n)) == k))
                        found += batch.search(hops, left, stride, max_hops, fits=True)
                    self.free(*self.mine)
                    return found
                if not self.open.isEmpty():
                    self.grow(side)
                left, fits = left - 1, False
            met = _met(self.open, self.ring)
            found.append(met.withColumn("hops", F.lit(hops)))
            self.close(met)
            hops, left = hops + stride, stride
        self.free(*self.mine)
        return found


def pair_distances(edges: DataFrame, pairs: DataFrame, max_hops: int, room: int | None = None) -> DataFrame:
    """(source, target, hops) of the wanted pairs(source, target) that are at most max_hops apart, the edges taken both ways.

    Two frontiers: rings of nodes grow around the sources and around the targets, of pairs that have
    not met yet only, on the side whose next ring is the smaller.  A pair has met where a ring of one side
    shares a node with the last ring of the other; the first touch is its distance, as sides grow by one
    hop at a time.  Each pair is looked up from the smaller of its two rings, so a hub's ring is not listed
    for every pair of the hub.  From three hops on, pairs of two components are left out before.  Where no
    node is both a src and a tgt, a pair's distance is odd or even by its ends, and only such are looked at.

    At most room steps (the number of edges, of one way or both) are listed at once, see _Rings.search(), and tables and
    shuffle files go when they have been read, so the disk is in proportion to the edges and not to all rings.
    """
    with lean(edges.sparkSession):
        e = settled(edges.select("src", "tgt").filter("src <> tgt").distinct())
        count = lambda c, out: e.select(F.col(c).alias("u"), F.lit(out).alias("outs"), F.lit(1 - out).alias("ins"))
        degree = settled(count("src", 1).unionByName(count("tgt", 0)).groupBy("u").agg(F.count("*").alias("n"), F.sum("outs").alias("outs"), F.sum("ins").alias("ins")))
        open_ = settled(pairs.select("source", "target").filter("source is not null and target is not null").distinct())
        done = open_.filter("source = target").withColumn("hops", F.lit(0))
        wanted = open_.filter("source <> target")
        if max_hops > 2:
            part = settled(whole := connected_components(e, plain=True))
            dropped(whole)
            of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
            wanted = wanted.join(of("source"), "source").join(of("target"), "target").filter("_source = _target").select("source", "target")
        sides = degree.filter("outs > 0 and ins > 0").isEmpty()
        room = room or max(e.count() * (1 if sides else 2), ROOM)
        # 1: steps lead from src to tgt, -1: from tgt to src, 0: both
        step = {1: e.toDF("u", "v"), -1: e.select(F.col("tgt").alias("u"), F.col("src").alias("v"))}
        step[0] = both_ways(e)
        at = lambda c: degree.select(F.col("u").alias(c), F.when(F.lit(not sides), 0).when(F.col("outs") > 0, 1).otherwise(-1).alias(f"_{c}"))
        wanted = settled(wanted.join(at("source"), "source").join(at("target"), "target"))
        if max_hops > 2:
            dropped(part)
        for s, t in sorted(tuple(r) for r in wanted.select("_source", "_target").distinct().collect()):  # four at most
            some = settled(wanted.filter((F.col("_source") == s) & (F.col("_target") == t)).select("source", "target"))
            rings = _Rings(step, degree, some, {"source": s, "target": t}, room)
            hops, stride = (1, 1) if not sides else (2, 2) if s == t else (1, 2)
            for met in rings.search(hops, hops, stride, max_hops):
                done = done.unionByName(met)
            dropped(some)
        dropped(e, degree, wanted)
    return done


def occurrences(table: DataFrame, key: list[str]) -> DataFrame:
    """How many distinct sources each node or edge has."""
    return table.select(*key, F.size(F.array_distinct("source_ids")).cast("long").alias("occurrences"))
