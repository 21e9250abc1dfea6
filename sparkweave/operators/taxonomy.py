"""Taxonomies and intents: depths, closure, validation, sampling, linking, coverage."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import graph as G
from ..functions import text as T
from . import tours

DIMENSIONS = ("concept_explanation", "relational_reasoning", "rule_compliance", "anomaly_diagnosis", "comparative_analysis", "procedural_knowledge")


def roots(tree: DataFrame) -> DataFrame:
    """Nodes whose parent is null or unknown."""
    ids = tree.select(F.col("id").alias("parent_id"))
    return tree.join(ids, "parent_id", "left_anti")


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, id, distance) over all nodes below roots, each its own ancestor; members of cycles are not reached."""
    G.ensure_checkpoint_dir(tree.sparkSession)
    up = tree.join(tree.select(F.col("id").alias("p")), F.col("parent_id") == F.col("p"), "left").select("id", F.col("p").alias("parent"))
    level = roots(tree).select("id", F.array("id").alias("path"))
    out = level
    while True:  # no path from a root has a cycle
        level = up.join(level.select(F.col("id").alias("parent"), "path"), "parent").select("id", F.array_append("path", F.col("id")).alias("path")).checkpoint()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    x = out.select("id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor"))
    return x.select("ancestor", "id", (F.col("n") - 1 - F.col("pos")).alias("distance")).checkpoint()


def with_depth(tree: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Adds depth (null for nodes no root reaches) and is_leaf."""
    depth = tours.depths(tree).select("id", "depth") if paths is None else paths.groupBy("id").agg(F.max("distance").alias("depth"))
    parents = tree.select(F.col("parent_id").alias("id")).filter("id is not null").distinct().withColumn("_p", F.lit(True))
    return tree.join(depth, "id", "left").join(parents, "id", "left").withColumn("is_leaf", F.col("_p").isNull()).drop("_p")


def node(tree: DataFrame, node_id: str) -> DataFrame:
    """The row of one node, none where it is unknown."""
    return tree.filter(F.col("id") == node_id)


def at_depth(deep: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth, from with_depth()."""
    return deep.filter(F.col("depth") == depth)


def by_dimension(tree: DataFrame, dimension: str) -> DataFrame:
    return tree.filter(F.col("cognitive_dimension") == dimension)


def branch(paths: DataFrame, node: str) -> DataFrame:
    """From the root to the node: (id, position)."""
    x = paths.filter(F.col("id") == node)
    return x.select(F.col("ancestor").alias("id"), (F.max("distance").over(Window.partitionBy("id")) - F.col("distance")).alias("position"))


def subtree(paths: DataFrame, node: str) -> DataFrame:
    return paths.filter(F.col("ancestor") == node).select("id", "distance")


def siblings(tree: DataFrame) -> DataFrame:
    """(id, sibling) under one parent; roots are siblings of roots."""
    top = roots(tree).select("id").withColumn("_root", F.lit("\u0001root"))
    t = tree.join(top, "id", "left").select("id", F.coalesce("_root", "parent_id").alias("p"))
    return t.join(t.select(F.col("id").alias("sibling"), "p"), "p").filter("id <> sibling").select("id", "sibling")


def sibling_counts(tree: DataFrame) -> DataFrame:
    """(id, parent_id, siblings): how many other nodes each node's parent has; roots count roots."""
    top = roots(tree).select("id").withColumn("_root", F.lit("\u0001root"))
    t = tree.select("id", "parent_id").join(top, "id", "left").withColumn("_p", F.coalesce("_root", "parent_id"))
    sizes = t.groupBy("_p").agg((F.count("*") - 1).alias("siblings"))
    return t.join(sizes, "_p").select("id", "parent_id", "siblings")


def validate(tree: DataFrame, max_depth: int = 10) -> DataFrame:
    """(level, rule, id): what is wrong with a tree."""
    d = with_depth(tree)
    issue = lambda df, level, rule: df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col("id"))
    one = tree.sparkSession.range(1).select(F.lit(None).cast("string").alias("id"))
    out = issue(roots(tree).filter("parent_id is not null"), "WARNING", "orphan")
    out = out.unionByName(issue(tree.filter(~F.coalesce(F.col("cognitive_dimension").isin(*DIMENSIONS), F.lit(True))), "WARNING", "unknown_dimension"))
    out = out.unionByName(issue(d.filter(F.col("depth") > max_depth), "WARNING", "too_deep"))
    out = out.unionByName(issue(d.filter("depth is null"), "ERROR", "unreachable"))
    if tree.isEmpty():
        out = out.unionByName(issue(one, "ERROR", "no_nodes"))
    elif roots(tree).isEmpty():
        out = out.unionByName(issue(one, "ERROR", "no_roots"))
    return out


def statistics(tree: DataFrame) -> DataFrame:
    """(what, value, n): totals, and distributions over dimension and depth, in one pass."""
    d = with_depth(tree)
    x = d.groupingSets([["cognitive_dimension"], ["depth"], []], "cognitive_dimension", "depth").agg(F.count("*").alias("n"), F.sum(F.col("is_leaf").cast("int")).alias("leaves"), F.grouping_id().alias("g"))
    sets = x.select(F.when(F.col("g") == 1, "dimension").when(F.col("g") == 2, "depth").otherwise("nodes").alias("what"), F.when(F.col("g") == 1, F.col("cognitive_dimension")).when(F.col("g") == 2, F.col("depth").cast("string")).alias("value"), "n")
    return sets.unionByName(x.filter("g = 3").select(F.lit("leaves").alias("what"), F.lit(None).cast("string").alias("value"), F.col("leaves").alias("n")))


def nested_json(tree: DataFrame) -> DataFrame:
    """(root, at, piece): the roots' nested JSON as rows, to be read or written in order; see tours.write_nested()."""
    return tours.nested_steps(G.settled(tours.euler_tour(tree)), tree)


# Sampling


def _u(seed: int) -> Column:
    """Uniform in (0, 1], by seed and id."""
    return (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 1) / float(1 << 52)


def in_order(d: DataFrame, seed: int) -> DataFrame:
    """Rows (id, is_leaf, ...) in the order they are sampled in: leaves first, each kind in seeded order."""
    return d.orderBy(~F.col("is_leaf"), _u(seed), "id")


def sample_branches(tree: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k nodes spread evenly over roots, leaves first; the remainder goes to roots in seeded order."""
    paths = closure(tree)
    top = roots(tree).select(F.col("id").alias("root"))
    n = max(1, top.count())
    d = with_depth(tree, paths).join(paths.join(top, F.col("ancestor") == F.col("root")).select("id", "root"), "id")
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("is_leaf"), _u(seed)))
    first = d.withColumn("place", place).withColumn("turn", F.col("place") - 1)
    return first.orderBy("turn", F.xxhash64(F.lit(seed), "root")).limit(k).select("id", "root", "is_leaf") if k < n else first.orderBy("turn", F.xxhash64(F.lit(seed), "root"), "id").limit(k).select("id", "root", "is_leaf")


def sample_by_depth(tree: DataFrame, k: int, factor: float = 1.0, seed: int = 0) -> DataFrame:
    """k nodes without replacement, weight ((depth + 1) / (deepest + 1)) ** factor (Efraimidis and Spirakis keys)."""
    d = with_depth(tree).filter("depth is not null").checkpoint()
    deepest = d.agg(F.max("depth")).first()[0] or 0
    w = F.pow((F.col("depth") + 1) / (deepest + 1), F.lit(factor))
    return d.withColumn("key", F.ln(_u(seed)) / w).orderBy(F.desc("key"), "id").limit(k).select("id", "depth")


def sample_uncovered(tree: DataFrame, history: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k nodes: uncovered leaves, then uncovered internal ones, then covered ones."""
    d = with_depth(tree).join(history.select("id").distinct().withColumn("covered", F.lit(True)), "id", "left").na.fill({"covered": False})
    return d.orderBy("covered", ~F.col("is_leaf"), _u(seed), "id").limit(k).select("id", "covered", "is_leaf")


def coverage(tree: DataFrame, history: DataFrame) -> DataFrame:
    """(what, value, n, covered, ratio): overall, leaves, by dimension and by depth."""
    d = with_depth(tree).join(history.select("id").distinct().withColumn("c", F.lit(1)), "id", "left").na.fill({"c": 0})
    agg = [F.count("*").alias("n"), F.sum("c").alias("covered"), F.avg("c").alias("ratio")]
    part = lambda df, what, value: df.groupBy(value.alias("value")).agg(*agg).select(F.lit(what).alias("what"), "value", "n", "covered", "ratio")
    none = F.lit(None).cast("string")
    out = part(d, "overall", none).unionByName(part(d.filter("is_leaf"), "leaf", none))
    return out.unionByName(part(d, "dimension", F.col("cognitive_dimension"))).unionByName(part(d, "depth", F.col("depth").cast("string")))


# Intents


#: Bytes of keywords of one automaton; more keywords take more passes over the nodes.
AUTOMATON_BYTES = 16 << 20


def keyword_hits(table: DataFrame, key: str, text: str, keywords: DataFrame, pass_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, kw): which of keywords(kw) occur anywhere in each row's text; one scan of the table a pass.

    A pass builds an automaton of keywords that fit in pass_bytes, dealt by hash, so what a task holds is bounded.
    """
    spark = table.sparkSession
    kw = G.settled(keywords.filter("kw <> ''").select("kw").distinct())
    passes = max(1, -(-(kw.agg(F.sum(F.octet_length("kw"))).first()[0] or 0) // pass_bytes))
    kind = table.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"key {kind}, kw string")
    rows = table.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k in range(passes):
        words = [r["kw"] for r in kw.filter(F.pmod(F.xxhash64("kw"), F.lit(passes)) == k).collect()]  # about pass_bytes
        if not words:
            continue
        sent = spark.sparkContext.broadcast(words)

        def scan(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            for w in sent.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = {w for _, w in automaton.iter(text)}
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "kw"])

        out = out.unionByName(rows.mapInArrow(scan, f"key {kind}, kw string")) if k else rows.mapInArrow(scan, f"key {kind}, kw string")
    return out.withColumnRenamed("key", key)


def link_intents(intents: DataFrame, nodes: DataFrame, min_score: float = 0.1, top: int = 5) -> DataFrame:
    """intents(intent_id, text), nodes(node_id, description, ...) -> (intent_id, node_id, score).

    score: the share of an intent's keywords that occur anywhere in the node's id, description,
    entity_type, name or label.  Nodes are read once, by an automaton of all keywords.
    """
    parts = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in ("node_id", "description", "entity_type", "name", "label") if c in nodes.columns]
    hay = nodes.select("node_id", F.concat_ws(" ", *parts).alias("hay"))
    words = intents.select("intent_id", T.keywords("text").alias("kw")).filter(F.size("kw") > 0)
    words = G.settled(words.select("intent_id", F.size("kw").alias("total"), F.explode("kw").alias("kw")))
    hits = G.settled(keyword_hits(hay, "node_id", "hay", words))
    x = words.join(hits, "kw").groupBy("intent_id", "node_id").agg((F.count("*") / F.first("total")).alias("score")).filter(F.col("score") >= min_score)
    rank = Window.partitionBy("intent_id").orderBy(F.desc("score"), "node_id")
    return x.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("intent_id", "node_id", "score", "rank")


def intent_subgraphs(intents: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, max_nodes: int = 20, min_score: float = 0.1, links: DataFrame | None = None) -> DataFrame:
    """(intent_id, text): the serialized neighbourhood of each intent's linked nodes; links(intent_id, node_id) where they are known."""
    seeds = link_intents(intents, nodes, min_score).select("intent_id", "node_id") if links is None else links.select("intent_id", "node_id").join(intents.select("intent_id"), "intent_id", "left_semi")
    n, e = G.k_hop(edges, seeds, max_hops, max_nodes)
    ns = n.join(nodes.select("node_id", "description"), "node_id", "left").groupBy("intent_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("node_id"), F.lit(": "), F.coalesce("description", F.lit(""))))).alias("ns"))
    es = e.groupBy("intent_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("src"), F.lit(" - "), F.col("tgt")))).alias("es"))
    x = ns.join(es, "intent_id", "left")
    return x.select("intent_id", F.array_join(F.concat("ns", F.coalesce("es", F.array().cast("array<string>"))), "\n").alias("text"))


def dimension_shares(results: DataFrame) -> DataFrame:
    """(cognitive_dimension, n, share) of results."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return results.groupBy("cognitive_dimension").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def intent_report(tree: DataFrame, results: DataFrame) -> DataFrame:
    """One row: coverage and dimension shares as JSON."""
    c = coverage(tree, results.select(F.col("intent_id").alias("id"))).agg(F.to_json(F.array_sort(F.collect_list(F.struct("what", "value", "n", "covered", "ratio")))).alias("coverage"))
    s = dimension_shares(results).agg(F.to_json(F.array_sort(F.collect_list(F.struct("cognitive_dimension", "n", "share")))).alias("shares"))
    return c.crossJoin(s)  # one row each


def enriched(tree: DataFrame, responses: DataFrame) -> DataFrame:
    """tree with new descriptions by id, the old ones where none came."""
    return tree.join(responses.select("id", F.col("description").alias("_d")), "id", "left").withColumn("description", F.coalesce("_d", "description")).drop("_d")


def taxonomy_prompt(document: Column, limit: int = 15000) -> Column:
    return F.concat(F.lit("Derive a taxonomy of intents, as JSON with id, name, cognitive_dimension and children, from:\n"), F.substring(document, 1, limit))
