"""Trees as intervals: an Euler tour found by pointer doubling.

Each node has an entry and an exit; the tour goes from an entry to the first child's, or to the
node's own exit, and from an exit to the next sibling's entry, or to the parent's exit.  Doubling pointers
ranks the tour's steps in about log2(2n) joins whatever the depth, so a chain is no slower than a star.
Afterwards an ancestor is a range test, a branch or subtree is a filter, and nested text is the
steps written in order, one row a step: no row holds a path or a subtree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import graph as G


def following(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows and `next`: the value of order in the next row of equal keys, null at the last.

    Rows are sorted by range, so equal keys may lie in many partitions and a key with most of the rows
    is no task of its own; the first row of each partition is the only thing that crosses.
    """
    cuts = G.settled(rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(*keys, order)
    x = cuts.withColumn("_next", F.lead(F.struct(*keys, order)).over(inside))
    heads = cuts.groupBy("_p").agg(F.min(F.struct(*keys, order)).alias("_head"))  # a row a partition
    heads = heads.select("_p", F.lead("_head").over(Window.orderBy("_p")).alias("_after"))
    x = x.join(F.broadcast(heads), "_p").withColumn("_next", F.coalesce("_next", "_after"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_next.{k}").eqNullSafe(F.col(k))
    return x.withColumn("next", F.when(same, F.col(f"_next.{order}"))).drop("_p", "_next", "_after")


def euler_tour(tree: DataFrame) -> DataFrame:
    """tree(id, parent_id) -> (id, parent_id, root, enter, leave, depth, is_leaf), for nodes below roots.

    Roots have a null or unknown parent; members of cycles have no root and no row.  Of repeated ids the
    smallest parent counts.  enter and leave number the steps of each root's tour from 0, children in
    order of id.
    """
    t = tree.filter("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = t.select(F.col("id").alias("p"))
    t = G.settled(t.join(known, F.col("parent_id") == F.col("p"), "left").select("id", "parent_id", "p"))
    # leaves are two steps in a row, so steps of inner nodes alone are ranked, over the leaves between them
    inner = t.filter("p is not null").select(F.col("p").alias("id")).distinct().withColumn("inner", F.lit(True))
    kids = G.settled(G.numbered(t.filter("p is not null").select("p", "id"), "p", "id").join(inner, "id", "left").select("p", "id", F.col("_place").alias("place"), F.coalesce("inner", F.lit(False)).alias("inner")))
    of = G.settled(kids.groupBy("p").agg(F.min("place").alias("begin"), F.max("place").alias("end"), F.min(F.when(F.col("inner"), F.struct("place", "id"))).alias("first")))
    later = following(kids.filter("inner").select("p", F.struct("place", "id").alias("at")), ["p"], "at")
    later = later.join(of.select("p", "end"), "p").select(F.col("at.id").alias("id"), F.col("at.place").alias("place"), F.col("next.id").alias("next"), F.col("next.place").alias("next_place"), "end")
    x = of.withColumnRenamed("p", "id").join(t.select("id", "p"), "id").join(later.withColumnRenamed("end", "above_end"), "id", "left")
    step = lambda node, out: F.struct(F.col(node).alias("id"), F.lit(out).alias("out"))
    over = lambda leaves: (F.lit(1) + 2 * leaves).cast("long")
    down = F.col("first").isNotNull()
    enter = x.select(step("id", 0).alias("s"), F.when(down, step("first.id", 0)).otherwise(step("id", 1)).alias("to"), over(F.when(down, F.col("first.place")).otherwise(F.col("end") + 1) - F.col("begin")).alias("far"), F.lit(1).alias("up"))
    leave = x.select(step("id", 1).alias("s"), F.when(F.col("next").isNotNull(), step("next", 0)).when(F.col("p").isNotNull(), step("p", 1)).alias("to"), over(F.coalesce(F.col("next_place") - 1, "above_end") - F.col("place")).alias("far"), F.lit(-1).alias("up"))
    # to: a later step; far: how many steps on; up: entries less exits from this step to before that one; last: to ends the tour
    every = enter.unionByName(leave).select("s", F.coalesce("to", "s").alias("to"), F.col("to").isNull().alias("last"), F.when(F.col("to").isNull(), 0).otherwise(F.col("far")).cast("long").alias("far"), F.when(F.col("to").isNull(), 0).otherwise(F.col("up")).cast("long").alias("up"))
    state = G.settled(every)
    left = state.filter("not last").count()
    while left:
        ahead = state.select(F.col("s").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("far").alias("far2"), F.col("up").alias("up2"))
        on = state.filter("not last").join(ahead, "to").select("s", F.col("to2").alias("to"), F.col("last2").alias("last"), (F.col("far") + F.col("far2")).alias("far"), (F.col("up") + F.col("up2")).alias("up"))
        state = G.settled(state.filter("last").unionByName(on))
        before, left = left, state.filter("not last").count()
        if left == before:
            break  # no step leads to an ended one: what is left goes round
    done = state.filter("last")
    side = lambda out, **names: done.filter(F.col("s.out") == out).select(F.col("s.id").alias("id"), *[F.col(c).alias(n) for c, n in names.items()])
    ends = side(0, to="last", far="a", up="up").join(side(1, far="b"), "id")
    total = ends.filter("id = last.id").select(F.col("id").alias("root"), F.col("a").alias("steps"))
    y = ends.withColumn("root", F.col("last.id")).join(total, "root")
    # one node, the root, is open before the last step; what is open before a step is its depth
    y = y.select("id", "root", (F.col("steps") - F.col("a")).alias("enter"), (F.col("steps") - F.col("b")).alias("leave"), (F.lit(1) - F.col("up")).cast("int").alias("depth"))
    y = G.settled(y)
    # a child begins after its parent's entry and the steps of the children before it
    long = kids.join(y.select("id", (F.col("leave") - F.col("enter") + 1).alias("long")), "id", "left").select("p", "id", "place", "inner", F.coalesce("long", F.lit(2)).alias("long"))
    cuts = G.settled(long.repartitionByRange("place").withColumn("_p", F.spark_partition_id()))
    sums = cuts.groupBy("_p").agg(F.sum("long").alias("_s"))  # a row a partition
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("long").over(Window.partitionBy("_p").orderBy("place")) - F.col("long")
    cuts = G.settled(cuts.withColumn("_run", run).join(F.broadcast(sums), "_p").select("p", "id", "inner", (F.col("_run") + F.col("_before")).alias("run")))
    above = y.join(cuts.groupBy("p").agg(F.min("run").alias("begin")).withColumnRenamed("p", "id"), "id").select(F.col("id").alias("p"), "root", F.col("enter").alias("above"), "depth", "begin")
    low = cuts.filter("not inner").join(above, "p").withColumn("enter", F.col("above") + 1 + F.col("run") - F.col("begin"))
    low = low.select("id", F.col("p").alias("parent_id"), "root", "enter", (F.col("enter") + 1).alias("leave"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("is_leaf"))
    top = t.join(y, "id").select("id", "parent_id", "root", "enter", "leave", "depth", F.lit(False).alias("is_leaf"))
    lone = t.filter("p is null").join(inner, "id", "left_anti").select("id", "parent_id", F.col("id").alias("root"), F.lit(0).cast("long").alias("enter"), F.lit(1).cast("long").alias("leave"), F.lit(0).alias("depth"), F.lit(True).alias("is_leaf"))
    return low.unionByName(top).unionByName(lone)


def depths(tree: DataFrame) -> DataFrame:
    """(id, root, depth) of nodes below roots, by doubling pointers to ancestors: log2(deepest) joins."""
    t = tree.filter("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    t = t.join(t.select(F.col("id").alias("p")), F.col("parent_id") == F.col("p"), "left")
    state = G.settled(t.select("id", F.coalesce("p", "id").alias("to"), F.col("p").isNull().alias("last"), F.col("p").isNotNull().cast("int").alias("far")))
    left = state.filter("not last").count()
    while left:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("far").alias("far2"))
        on = state.filter("not last").join(ahead, "to").select("id", F.col("to2").alias("to"), F.col("last2").alias("last"), (F.col("far") + F.col("far2")).alias("far"))
        state = G.settled(state.filter("last").unionByName(on))
        before, left = left, state.filter("not last").count()
        if left == before:
            break  # what is left goes round
    return state.filter("last").select("id", F.col("to").alias("root"), F.col("far").alias("depth"))


def ancestors(tour: DataFrame, node: str) -> DataFrame:
    """(id, position) from the root to the node, by range."""
    at = tour.filter(F.col("id") == node).select(F.col("root").alias("_r"), F.col("enter").alias("_e"), F.col("leave").alias("_l"))
    x = tour.join(F.broadcast(at), (F.col("root") == F.col("_r")) & (F.col("enter") <= F.col("_e")) & (F.col("leave") >= F.col("_l")))  # one row
    return x.select("id", F.col("depth").alias("position"))


def descendants(tour: DataFrame, node: str) -> DataFrame:
    """(id, distance) of the node and all below it, by range."""
    at = tour.filter(F.col("id") == node).select(F.col("root").alias("_r"), F.col("enter").alias("_e"), F.col("leave").alias("_l"), F.col("depth").alias("_d"))
    x = tour.join(F.broadcast(at), (F.col("root") == F.col("_r")) & F.col("enter").between(F.col("_e"), F.col("_l")))  # one row
    return x.select("id", (F.col("depth") - F.col("_d")).alias("distance"))


def subtree_totals(tour: DataFrame, value: Column | None = None) -> DataFrame:
    """(id, size, total): nodes of each node's subtree and the sum of value (default 1) over them, from running sums over the steps.

    The subtree of a node is the entries between its own and its exit, so its total is a difference of two
    running sums; steps are summed by range first and within ranges after, never in one task.
    """
    v = F.lit(1.0) if value is None else value.cast("double")
    steps = tour.select("root", F.col("enter").alias("at"), v.alias("v"), "id", F.lit(0).alias("out")).unionByName(tour.select("root", F.col("leave").alias("at"), F.lit(0.0).alias("v"), "id", F.lit(1).alias("out")))
    cuts = G.settled(steps.repartitionByRange("root", "at").sortWithinPartitions("root", "at").withColumn("_p", F.spark_partition_id()))
    sums = cuts.groupBy("_p").agg(F.sum("v").alias("_s"))  # a row a partition
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    run = F.sum("v").over(Window.partitionBy("_p").orderBy("root", "at"))
    x = cuts.withColumn("_run", run).join(F.broadcast(sums), "_p").select("id", "out", "at", (F.col("_run") + F.col("_before")).alias("r"), "v")
    a = x.filter("out = 0").select("id", F.col("at").alias("a"), (F.col("r") - F.col("v")).alias("ra"))
    b = x.filter("out = 1").select("id", F.col("at").alias("b"), F.col("r").alias("rb"))
    return a.join(b, "id").select("id", ((F.col("b") - F.col("a") + 1) / 2).cast("long").alias("size"), (F.col("rb") - F.col("ra")).alias("total"))


def nested_steps(tour: DataFrame, nodes: DataFrame, fields: tuple[str, ...] = ("id", "name", "cognitive_dimension")) -> DataFrame:
    """(root, at, piece): the pieces of each root's nested JSON, to be read in order of at."""
    own = F.regexp_replace(F.to_json(F.struct(*fields)), r"\}$", "")
    x = tour.join(nodes.select(*dict.fromkeys(["id", *fields])), "id")
    older = following(tour.filter("depth > 0").select("root", F.col("parent_id").alias("p"), "enter", "id"), ["root", "p"], "enter").filter("next is not null")
    later = older.select("root", F.col("next").alias("enter"), F.lit(",").alias("comma"))
    opened = x.join(later, ["root", "enter"], "left").select("root", F.col("enter").alias("at"), F.concat(F.coalesce("comma", F.lit("")), own, F.lit(',"children":[')).alias("piece"))
    return opened.unionByName(x.select("root", F.col("leave").alias("at"), F.lit("]}").alias("piece")))


def write_nested(pieces: DataFrame, path: str) -> None:
    """The pieces, a line each, as text files that are the roots' nested JSON when read one after another; no row holds a tree."""
    pieces.repartitionByRange("root", "at").sortWithinPartitions("root", "at").select("piece").write.text(path)


def outline(tour: DataFrame, nodes: DataFrame, layout: str = "markdown") -> DataFrame:
    """(root, at, line) of each tree in pre-order: headings (six levels at most) or dashes with the description."""
    x = tour.join(nodes.select("id", F.col("description").alias("_d")), "id", "left")
    about = F.coalesce("_d", F.lit(""))
    line = {
        "markdown": F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), F.col("id"), F.when(about != "", F.concat(F.lit("\n"), about)).otherwise("")),
        "outline": F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("id"), F.when(about != "", F.concat(F.lit(": "), about)).otherwise("")),
    }[layout]
    return x.select("root", F.col("enter").alias("at"), line.alias("line"))
