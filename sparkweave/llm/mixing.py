"""Mixing sources to target weights.  DataFrame functions only.

A budget of tokens flows down a tree (such as domain, language, source).  A node's
budget is dealt to its children by weight; a child that cannot use its share (its
tokens times max_epochs, summed over its subtree) takes what it can, and its siblings
share the rest by weight.  As capacities are those of whole subtrees, a shortage is
made up among siblings first, and reaches their parent's siblings only where the
parent itself is exhausted.  Each leaf then takes whole epochs of its documents and a
prefix, in tokens, of one more epoch, in an order seeded by epoch.

The order is md5(seed:epoch:doc_id).  Where the prefix ends is found by descent: sums
per 12 bits of the hash, then per the next 12 bits inside the one part that holds the
end, then a running sum over the few documents left; no leaf is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._blocks import shared_checkpoint_dir, with_small

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
_D = "decimal(38,0)"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def share_out(children: DataFrame, budgets: DataFrame) -> DataFrame:
    """children(parent, node, weight, cap), budgets(parent, budget) -> (node, budget).

    Children in order of cap / weight: those whose cap is within their share of what is
    left are full; the others share the remainder, rounded down.
    """
    before = Window.partitionBy("parent").orderBy(F.col("cap") / F.col("weight"), "node").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("parent").orderBy(F.col("cap") / F.col("weight"), "node").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("parent")
    x = children.filter("weight > 0").join(budgets, "parent")
    x = x.withColumns({"taken": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(rest)})
    full = F.col("cap").cast(_D) * F.col("open") <= (F.col("budget") - F.col("taken")).cast(_D) * F.col("weight")
    x = x.withColumn("is_full", full)
    x = x.withColumns({"used": F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(whole), "left": F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("weight"))).over(whole)})
    part = F.expr(f"cast(cast(budget - used as {_D}) * weight div left as bigint)")
    return x.select("node", F.when(F.col("is_full"), F.col("cap")).otherwise(part).alias("budget"))


def _key(levels: dict[str, Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("string"), F.lit(NONE)) for c in levels.values()])


def leaf_plan(slim: DataFrame, depth: int, weights: DataFrame | None, share: float, max_epochs: int) -> DataFrame:
    """slim(leaf: array of names, n_tokens) -> (leaf, tokens, budget, epochs, rest)."""
    leaves = slim.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens")).checkpoint()
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    root = F.array().cast("array<string>")
    budgets = slim.sparkSession.range(1).select(root.alias("parent"), F.lit(int(total * round(share * 1000)) // 1000).cast("long").alias("budget"))
    for k in range(1, depth + 1):
        node, parent = F.slice("leaf", 1, k), F.slice("leaf", 1, k - 1) if k > 1 else root
        children = leaves.groupBy(node.alias("node"), parent.alias("parent")).agg((F.sum("tokens") * max_epochs).alias("cap"))
        if weights is None:
            children = children.withColumn("weight", F.lit(1).cast("long"))
        else:
            children = children.join(weights.select(F.col("node"), F.col("weight").cast("long").alias("weight")), "node", "left").na.fill(1, ["weight"])
        budgets = share_out(children, budgets).withColumnRenamed("node", "parent")
    plan = leaves.join(budgets.withColumnRenamed("parent", "leaf"), "leaf").filter("budget > 0 and tokens > 0")
    return plan.select("leaf", "tokens", "budget", F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")).checkpoint()


def prefix_ends(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(leaf, cut_hash, cut_id, cut_tokens): the document in which each leaf's prefix ends, and its tokens there."""
    docs = with_small(slim, plan.filter("rest > 0").select("leaf", "epochs", "rest"), "leaf").filter("rest is not null")
    docs = docs.withColumn("hash", order_hash(seed)).select("leaf", "doc_id", "n_tokens", "hash", "rest")

    def descend(rows, first, width):
        """The part of the hash in which the running sum reaches what is left to take."""
        sums = rows.groupBy("leaf", F.substring("hash", first, width).alias("part")).agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("goal"))
        run = F.sum("n").over(Window.partitionBy("leaf").orderBy("part"))
        ends = sums.withColumn("run", run).filter("run >= goal").groupBy("leaf").agg(F.min_by(F.struct("part", "run", "n"), "part").alias("x"))
        return ends.select("leaf", F.col("x.part").alias("part"), (F.col("x.run") - F.col("x.n")).alias("taken"))

    for first in (1, 4):
        ends = descend(docs, first, 3).checkpoint()
        docs = with_small(docs, ends, "leaf").filter(F.substring("hash", first, 3) == F.col("part"))
        docs = docs.withColumn("rest", F.col("rest") - F.col("taken")).drop("part", "taken")
    places = docs.groupBy("leaf", "hash", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    run = F.sum("n").over(Window.partitionBy("leaf").orderBy("hash", "doc_id"))
    last = places.withColumn("run", run).filter("run >= rest").groupBy("leaf").agg(F.min_by(F.struct("hash", "doc_id", (F.col("rest") - F.col("run") + F.col("n")).alias("tokens")), F.struct("hash", "doc_id")).alias("x"))
    return last.select("leaf", F.col("x.hash").alias("cut_hash"), F.col("x.doc_id").alias("cut_id"), F.col("x.tokens").alias("cut_tokens"))


def order_hash(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))))


def _chosen(docs: DataFrame, levels: dict[str, Column], weights, share, max_epochs, seed) -> DataFrame:
    """row (the columns of docs), leaf, n_tokens, epochs (whole ones), part (tokens of one more), epoch order aside."""
    shared_checkpoint_dir(docs.sparkSession)
    wide = docs.select(F.struct("*").alias("row"), _key(levels).alias("leaf"), F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("n_tokens"))
    slim = wide.select("leaf", "doc_id", "n_tokens").checkpoint()
    plan = leaf_plan(slim, len(levels), weights, share, max_epochs)
    plan = plan.join(prefix_ends(slim, plan, seed), "leaf", "left").select("leaf", "epochs", "cut_hash", "cut_id", "cut_tokens").checkpoint()
    return with_small(wide, plan, "leaf").filter("epochs is not null").withColumn("hash", order_hash(seed)).withColumn("part", _part())


def _part() -> Column:
    same = (F.col("hash") == F.col("cut_hash")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    before = (F.col("hash") < F.col("cut_hash")) | (F.col("hash") == F.col("cut_hash")) & F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull())
    return F.when(F.col("cut_hash").isNull(), 0).when(same, F.least("n_tokens", "cut_tokens")).when(before, F.col("n_tokens")).otherwise(0).cast("long")


def mix_report(docs: DataFrame, levels: dict[str, Column], weights: DataFrame | None = None, share: float = 0.5, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """What the mix takes of each row of docs that it takes: doc_id, leaf, n_tokens, whole_epochs, part_tokens.

    levels: names from the root down.  weights(node: array of names, weight): nodes that it
    lacks weigh 1, nodes of weight 0 or less get nothing.  share: the budget, in thousandths
    of the corpus's tokens, rounded.  Rounding leaves at most one token per node unused.  A null name
    is '(none)'; null text has no tokens, and a document without tokens is never taken.
    Rows that share a doc_id share a place in the order and are cut alike, so only they may
    overshoot.  Other columns of docs are ignored.
    """
    out = _chosen(docs, levels, weights, share, max_epochs, seed)
    out = out.select("doc_id", F.array_join("leaf", "/").alias("leaf"), "n_tokens", F.col("epochs").alias("whole_epochs"), F.col("part").alias("part_tokens"))
    return out.filter("n_tokens > 0 and (whole_epochs > 0 or part_tokens > 0)")


def mix(docs: DataFrame, levels: dict[str, Column], weights: DataFrame | None = None, share: float = 0.5, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """The mixed corpus: the columns of docs, one row per document and epoch; the last text of a leaf's prefix is cut.

    Cases are those of mix_report().
    """
    out = _chosen(docs, levels, weights, share, max_epochs, seed).filter("n_tokens > 0")
    piece = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
    text = F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    whole = F.when(F.col("epochs") > 0, F.array_repeat(F.lit(True), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<boolean>"))
    copies = F.concat(whole, F.when(F.col("part") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = out.select("row", "part", "n_tokens", F.explode(copies).alias("is_whole"))
    text = F.when(F.col("is_whole") | (F.col("part") == F.col("n_tokens")), text).otherwise(cut)
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
