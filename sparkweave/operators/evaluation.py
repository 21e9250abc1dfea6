"""Evaluation sets, quality, critics, diversity, coverage, reviews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import graph as G

DIFFICULTIES = ("easy", "medium", "hard")


def eval_plan(batches: DataFrame, types: dict[str, float], difficulties: dict[str, float], target: int, per_batch: float = 2.5) -> DataFrame:
    """(type, difficulty, count, turn, batch_id): ceiling targets per cell, each with ceil(count / 2.5) batches, taken in turn."""
    cells, offset = [], 0
    for kind, share in types.items():
        for level, part in difficulties.items():
            count = math.ceil(math.ceil(target * share) * part)
            need = max(1, math.ceil(count / per_batch))
            cells.append((kind, level, count, need, offset))
            offset += need
    spark = batches.sparkSession
    plan = spark.createDataFrame(cells, "type string, difficulty string, count int, need int, first int").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("need") - 1)))
    n = min(batches.count(), offset)
    if n == 0:
        return plan.limit(0).select("type", "difficulty", "count", "turn", F.lit("").alias("batch_id"))
    first = batches.select("batch_id").orderBy("batch_id").limit(n).withColumn("pos", F.row_number().over(Window.orderBy("batch_id")) - 1)  # at most as many as the plan
    plan = plan.withColumn("pos", F.pmod(F.col("first") + F.col("turn"), F.lit(n)))
    return plan.join(first, "pos").select("type", "difficulty", "count", "turn", "batch_id")


def capped_per_cell(items: DataFrame, plan: DataFrame) -> DataFrame:
    cells = plan.select("type", "difficulty", "count").distinct()
    x = items.join(cells, ["type", "difficulty"]).withColumn("_n", F.row_number().over(Window.partitionBy("type", "difficulty").orderBy("id")))
    return x.filter(F.col("_n") <= F.col("count")).drop("_n", "count")


def distinct_questions(items: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """The first item by order of each question (case and outer space aside), and at most `most` of them."""
    key = F.lower(F.trim("question"))
    x = items.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return x.orderBy(order).limit(most) if most is not None else x


def dataset_statistics(items: DataFrame) -> DataFrame:
    """(what, value, n, share): totals, types, difficulties in one pass of grouping sets."""
    x = items.groupingSets([["type"], ["difficulty"], []], "type", "difficulty").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    x = x.select(F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "difficulty").otherwise("total").alias("what"), F.when(F.col("g") == 1, F.col("type")).when(F.col("g") == 2, F.col("difficulty")).alias("value"), "n")
    total = F.max(F.when(F.col("what") == "total", F.col("n"))).over(Window.partitionBy(F.lit(1)))  # a row per value
    return x.withColumn("share", F.col("n") / total)


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))


#: (name, what is counted, its full mark, weight), fixed values; length factors always count, others where above zero.
FACTORS = (("reasoning_hops", 5.0, 0.3), ("knowledge_points", 10.0, 0.2), ("question_length", 50.0, 0.15), ("answer_length", 100.0, 0.15), ("distractor_count", 5.0, 0.2))


def difficulty_scores(items: DataFrame) -> DataFrame:
    """Adds score and level; items have question, reference_answer, distractors, reasoning_hops, knowledge_nodes."""
    raw = {
        "reasoning_hops": F.coalesce("reasoning_hops", F.lit(0)), "knowledge_points": F.coalesce(F.size("knowledge_nodes"), F.lit(0)),
        "question_length": words("question"), "answer_length": words("reference_answer"), "distractor_count": F.coalesce(F.size("distractors"), F.lit(0)),
    }
    total, weight, reasons = F.lit(0.0), F.lit(0.0), []
    for name, full, w in FACTORS:
        on = F.lit(True) if name.endswith("length") else raw[name] > 0
        total = total + F.when(on, F.least(raw[name] / full, F.lit(1.0)) * w).otherwise(0.0)
        weight = weight + F.when(on, w).otherwise(0.0)
        if not name.endswith("length"):
            reasons.append(F.when(on, F.concat(F.lit(name + "="), raw[name].cast("string"))))
    x = items.withColumn("score", total / weight)
    level = F.when(F.col("score") < 0.4, "easy").when(F.col("score") < 0.7, "medium").otherwise("hard")
    return x.withColumns({"level": level, "reasoning": F.concat_ws(". ", F.concat(F.lit("level="), level), *reasons)})


def difficulty_report(scored: DataFrame) -> DataFrame:
    return scored.groupBy("level").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def item_quality(items: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Adds issues, suggestions, quality (1 less the penalties, within 0 and 1) and is_valid (from 0.5, with an answer)."""
    m = {"min_question": 5, "max_question": 200, "min_answer": 10, "max_answer": 500} | (limits or {})
    q, a = words("question"), words("reference_answer")
    num = lambda n: n.cast("string")
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    empty = bare("reference_answer") == ""
    # issues and suggestions: fixed values
    rules = [
        (q < m["min_question"], 0.2, F.concat(F.lit("Question too short ("), num(q), F.lit(" words)")), "Expand the question to be more specific"),
        (q > m["max_question"], 0.1, F.concat(F.lit("Question too long ("), num(q), F.lit(" words)")), "Simplify the question"),
        (a < m["min_answer"], 0.2, F.concat(F.lit("Answer too short ("), num(a), F.lit(" words)")), "Provide a more detailed answer"),
        (a > m["max_answer"], 0.1, F.concat(F.lit("Answer too long ("), num(a), F.lit(" words)")), "Condense the answer"),
        (~bare("question").rlike("[?？]$"), 0.05, F.lit("Question doesn't end with a question mark"), "Add a question mark at the end"),
        (empty, 0.5, F.lit("Answer is empty"), "Provide a reference answer"),
        (F.coalesce(F.size("evaluation_criteria"), F.lit(0)) <= 0, 0.1, F.lit("Missing evaluation criteria"), "Add evaluation criteria for scoring"),
        (F.coalesce(F.size("knowledge_nodes"), F.lit(0)) <= 0, 0.05, F.lit("Missing knowledge node information"), None),
    ]
    loss = sum((F.when(c, p).otherwise(0.0) for c, p, _, _ in rules), F.lit(0.0))
    x = items.withColumn("suggestions", F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, _, _, s in rules])))
    x = x.withColumns({"issues": F.array_compact(F.array(*[F.when(c, text) for c, _, text, _ in rules])), "quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - loss, 9)))})
    return x.withColumn("is_valid", (F.col("quality") >= 0.5) & ~empty)


def dataset_quality(checked: DataFrame) -> DataFrame:
    """One row: items, valid ones, average, bands and label."""
    q = F.col("quality")
    x = checked.agg(
        F.count("*").alias("total_items"), F.count_if("is_valid").alias("valid_items"), F.avg("quality").alias("average_quality"),
        F.count_if(q >= 0.8).alias("high"), F.count_if((q >= 0.6) & (q < 0.8)).alias("good"), F.count_if((q >= 0.4) & (q < 0.6)).alias("fair"), F.count_if(q < 0.4).alias("poor"),
    )
    a = F.col("average_quality")
    return x.withColumn("overall", F.when(a >= 0.8, "excellent").when(a >= 0.6, "good").when(a >= 0.4, "fair").otherwise("poor"))


def issue_counts(checked: DataFrame, top: int = 5) -> DataFrame:
    x = checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "issue").limit(top)


def diversity(items: DataFrame) -> DataFrame:
    """One row: mean of type, difficulty and first-word variety."""
    first = F.lower(F.regexp_extract("question", r"^\s*(\S+)", 1))
    x = items.agg(F.countDistinct("type").alias("types"), F.countDistinct("difficulty").alias("levels"), F.countDistinct(first).alias("firsts"), F.count("*").alias("n"))
    return x.select((F.when(F.col("n") > 0, (F.col("types") / 4.0 + F.col("levels") / 3.0 + F.col("firsts") / F.col("n")) / 3.0).otherwise(0.0)).alias("diversity"))


def good_items(checked: DataFrame, least: float = 0.5) -> DataFrame:
    return checked.filter((F.col("quality") >= least) & F.col("is_valid"))


def _before(tokens: Column) -> Column:
    """For each token of an array the position of its previous occurrence, -1 if it has none; by sorting, not by search."""
    place = F.array_sort(F.transform(tokens, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
    return F.transform(
        F.array_sort(F.zip_with(place, F.concat(F.array(F.lit(None).cast("struct<t:string,i:int>")), place), lambda x, y: F.when(x.isNotNull(), F.struct(x["i"].alias("i"), F.when(x["t"] == y["t"], y["i"]).otherwise(-1).alias("b"))))),
        lambda x: x["b"],
    )


def mtld(tokens: Column, threshold: float = 0.72) -> Column:
    """Measure of textual lexical diversity, forward and backward, in time linear in the tokens but for a sort.

    A token is a new type of its segment where its previous occurrence lies before the segment, so a
    segment is a count and a position instead of a set.
    """

    def factors(ts: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("f"), F.lit(0).alias("n"), F.lit(0).alias("types"), F.lit(0).alias("i"), F.lit(0).alias("since"))

        def add(acc, before):
            types = acc["types"] + F.when(before < acc["since"], 1).otherwise(0)
            n, i = acc["n"] + 1, acc["i"] + 1
            full = types / n <= threshold
            return F.struct((acc["f"] + F.when(full, 1.0).otherwise(0.0)).alias("f"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, 0).otherwise(types).alias("types"), i.alias("i"), F.when(full, i).otherwise(acc["since"]).alias("since"))

        def end(acc):
            rest = F.when(acc["n"] > 0, 1 - (acc["types"] / acc["n"] - threshold) / (1 - threshold)).otherwise(0.0)
            f = acc["f"] + rest
            return F.when(f > 0, acc["i"] / f).otherwise(acc["i"].cast("double"))

        return F.aggregate(F.filter(_before(ts), lambda b: b.isNotNull()), start, add, end)

    return F.when(F.size(tokens) > 0, (factors(tokens) + factors(F.reverse(tokens))) / 2).otherwise(0.0)


def content_tokens(text, stopwords) -> Column:
    t = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(t, lambda x: ~x.isin(*stopwords))


# Coverage of a graph by questions; covered(unit) come from qa.graph or qa.metadata


def covered_units(qa: DataFrame) -> DataFrame:
    """Distinct node ids of qa rows: graph.entities, else metadata.node_ids."""
    a = F.col("graph.entities") if "graph" in qa.columns else None
    b = F.col("metadata.node_ids") if "metadata" in qa.columns else None
    return qa.select(F.explode(F.coalesce(*[c for c in (a, b) if c is not None])).alias("node_id")).distinct()


def long_tail(counts: DataFrame, covered: DataFrame, key: list[str], most: int = 5) -> DataFrame:
    """One row: units with at most `most` sources, how many of them are covered, and the share."""
    rare = counts.filter(F.col("occurrences") <= most).select(*key)
    hit = covered.select(*key).distinct().withColumn("_c", F.lit(1))
    return rare.join(hit, key, "left").agg(F.count("*").alias("long_tail"), F.count("_c").alias("covered"), F.coalesce(F.count("_c") / F.count("*"), F.lit(0.0)).alias("share"))


def triangles(edges: DataFrame, cell: int = 512) -> DataFrame:
    """(u, p, q), p < q: each triangle of edges(src, tgt), each edge once, no loops.

    Edges point from the end of smaller degree, so no node points to more than sqrt(2m) others and a hub
    is not expanded.  A node that points to more than `cell` is heavy: its targets are hashed into
    cells, and each two cells meet as a group of their own, so no task holds the wedges of one node.
    """
    e = edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"))
    d = G.degrees(e)
    x = e.join(d.withColumnsRenamed({"node_id": "src", "degree": "a"}), "src").join(d.withColumnsRenamed({"node_id": "tgt", "degree": "b"}), "tgt")
    low = F.struct("a", "src") < F.struct("b", "tgt")
    out = G.settled(x.select(F.when(low, F.col("src")).otherwise(F.col("tgt")).alias("u"), F.when(low, F.col("tgt")).otherwise(F.col("src")).alias("v")))
    heavy = out.groupBy("u").agg(F.ceil(F.count("*") / cell).alias("cells")).filter("cells > 1")
    out = out.join(heavy, "u", "left").na.fill(1, ["cells"]).withColumn("c", F.pmod(F.xxhash64("v"), F.col("cells")))
    out = out.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    out = G.settled(out.select("u", "v", "c", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")))
    side = lambda name: out.select("u", "lo", "hi", F.col("v").alias(name), F.col("c").alias(f"c_{name}"))
    wedge = side("p").join(side("q"), ["u", "lo", "hi"]).filter("p < q and (lo = hi or c_p <> c_q)").select("u", "p", "q")
    return wedge.join(e.select(F.col("src").alias("p"), F.col("tgt").alias("q")), ["p", "q"]).select("u", "p", "q")


def common_neighbours(edges: DataFrame, cell: int = 512) -> DataFrame:
    """(src, tgt, common) of the edges whose ends have neighbours in common, src < tgt."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("tgt"))
    tri = triangles(edges, cell).select(F.explode(F.array(pair("u", "p"), pair("u", "q"), pair("p", "q"))).alias("x"))
    return tri.groupBy("x.src", "x.tgt").agg(F.count("*").alias("common"))


def twins(edges: DataFrame) -> DataFrame:
    """(node, like) of edges(src, tgt), each edge once, no loops: nodes that have the same neighbours, themselves included, as a smaller node `like`.

    Such nodes have equal sums of hashes; each class of equal sums is compared with its smallest node, neighbour
    by neighbour, and what differs is compared again among itself, so the result is exact and no wedge is listed.
    """
    near = G.both_ways(edges)
    near = G.settled(near.unionByName(near.select("u", F.col("u").alias("v")).distinct()))
    mark = F.xxhash64("v").cast("decimal(38,0)")
    left = G.settled(near.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.sum(mark).alias("h")))
    out = None
    while True:
        first = left.groupBy("n", "h").agg(F.min("node").alias("like"), F.count("*").alias("k")).filter("k > 1")
        some = G.settled(left.join(first, ["n", "h"]).filter("node <> like").select("node", "n", "h", "like"))
        if some.isEmpty():
            return out if out is not None else some.select("node", "like")
        both = some.join(near.withColumnRenamed("u", "node"), "node").join(near.withColumnRenamed("u", "like"), ["like", "v"], "left_semi").groupBy("node").agg(F.count("*").alias("same"))
        checked = G.settled(some.join(both, "node", "left").withColumn("same", F.coalesce(F.col("same") == F.col("n"), F.lit(False))))
        found = checked.filter("same").select("node", "like")
        out = found if out is None else out.unionByName(found)
        left = checked.filter("not same").select("node", "n", "h")


def on_paths_of_two(edges: DataFrame) -> DataFrame:
    """Edges that lie on a shortest path of length two: (src, tgt).

    A wedge u-v-w counts if u and w are not adjacent.  An edge (u, v) has such a w, on either side,
    exactly if u and v have not the same neighbours, themselves included; see twins().
    """
    G.ensure_checkpoint_dir(edges.sparkSession)
    e = G.settled(edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).filter("src <> tgt").distinct())
    same = twins(e)
    of = G.settled(same.unionByName(same.select(F.col("like").alias("node"), "like").distinct()))
    side = lambda c: of.select(F.col("node").alias(c), F.col("like").alias(f"_{c}"))
    y = e.join(side("src"), "src", "left").join(side("tgt"), "tgt", "left")
    return y.filter("_src is null or _tgt is null or _src <> _tgt").select("src", "tgt")


def mean_hops(qa_nodes: DataFrame, edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """qa_nodes(qa_id, node_id) -> (qa_id, mean_hops): mean shortest-path length of its node pairs within max_hops."""
    pairs = qa_nodes.alias("x").join(qa_nodes.alias("y"), F.expr("x.qa_id = y.qa_id and x.node_id < y.node_id")).select(F.col("x.qa_id").alias("qa_id"), F.col("x.node_id").alias("source"), F.col("y.node_id").alias("node_id"))
    reach = G.pair_distances(edges, pairs.select("source", F.col("node_id").alias("target")), max_hops).withColumnRenamed("target", "node_id")
    return pairs.join(reach, ["source", "node_id"]).groupBy("qa_id").agg(F.avg("hops").alias("mean_hops"))


# Critics and reviews


def rule_critic(qa: DataFrame, rules: list[tuple[str, Column, float]]) -> DataFrame:
    """Adds score (weighted share of rules passed), failed (names) and passed (all of them)."""
    total = sum(w for _, _, w in rules)
    ok = [(n, F.coalesce(c, F.lit(False)), w) for n, c, w in rules]
    score = sum((F.when(c, w).otherwise(0.0) for _, c, w in ok), F.lit(0.0)) / F.lit(total or 1.0)
    x = qa.withColumns({"score": score, "failed": F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c, _ in ok]))})
    return x.withColumn("passed", F.size("failed") == 0)


def usual_rules(min_answer: int = 20, min_question: int = 10, context: str | None = None) -> list[tuple[str, Column, float]]:
    rules = [
        ("answer_length", F.length(F.trim("answer")) >= min_answer, 1.0),
        ("question_length", F.length(F.trim("question")) >= min_question, 1.0),
        ("not_identical", F.lower(F.trim("question")) != F.lower(F.trim("answer")), 1.5),
    ]
    if context:
        split = lambda c: F.split(F.lower(F.col(c)), r"\s+")
        rules.append(("keyword_overlap", F.size(F.array_intersect(split("answer"), split(context))) > 0, 1.0))
    return rules


def accepted(verdicts: DataFrame, least: float = 0.6) -> DataFrame:
    return verdicts.filter(F.col("passed") & (F.col("score") >= least))


STATUSES = ("pending", "approved", "rejected", "modified", "auto_approved", "auto_rejected")


def review(items: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their latest action applied, actions on unknown items)."""
    last = actions.withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("review_time"), F.desc("review_status")))).filter("_n = 1").drop("_n")
    if "modified_content" in last.columns:
        last = last.withColumn("review_status", F.when(F.col("modified_content").isNotNull(), "modified").otherwise(F.col("review_status")))
    names = [c for c in last.columns if c != "item_id"]
    x = items.join(last.select("item_id", *[F.col(c).alias(f"_a_{c}") for c in names]), "item_id", "left")
    x = x.withColumns({c: F.coalesce(f"_a_{c}", c) if c in items.columns else F.col(f"_a_{c}") for c in names}).drop(*[f"_a_{c}" for c in names])
    return x, last.join(items.select("item_id"), "item_id", "left_anti")


def auto_status(score: Column, approve: float = 0.7, reject: bool = False) -> Column:
    out = F.when(score >= approve, "auto_approved")
    return (out.when(score < approve - 0.2, "auto_rejected") if reject else out).otherwise("pending")


def review_counts(items: DataFrame) -> DataFrame:
    """(review_status, n) for each of the six statuses."""
    every = items.sparkSession.createDataFrame([(s,) for s in STATUSES], "review_status string")
    return every.join(items.groupBy("review_status").agg(F.count("*").alias("n")), "review_status", "left").na.fill({"n": 0})


def merged_reviews(raw: DataFrame, saved: DataFrame) -> DataFrame:
    """Raw items with what was saved about them."""
    names = [c for c in saved.columns if c != "item_id"]
    x = raw.join(saved.select("item_id", *[F.col(c).alias(f"_s_{c}") for c in names]), "item_id", "left")
    return x.withColumns({c: F.coalesce(f"_s_{c}", c) if c in raw.columns else F.col(f"_s_{c}") for c in names}).drop(*[f"_s_{c}" for c in names])


TASK_STATES = ("pending", "processing", "auto_reviewing", "completed", "failed")


def task_summary(tasks: DataFrame) -> DataFrame:
    """(status, n) of tasks(status): the total, each usual status (0 where no task has it), and any other that occurs."""
    x = tasks.groupingSets([["status"], []], "status").agg(F.count("*").alias("n"), F.grouping("status").alias("g"))
    x = x.select(F.when(F.col("g") == 1, "total").otherwise(F.col("status")).alias("status"), "n")
    usual = tasks.sparkSession.createDataFrame([(s, 0) for s in TASK_STATES], "status string, n long")
    return x.unionByName(usual).groupBy("status").agg(F.sum("n").alias("n"))


def length_statistics(table: DataFrame, by: list[str], length: Column) -> DataFrame:
    """by, docs, avg, min, max and the quartiles' estimates of a length, nulls left out."""
    x = table.select(*by, length.cast("long").alias("_n"))
    quart = F.percentile_approx("_n", [0.25, 0.5, 0.75], 10_000)
    return x.groupBy(*by).agg(F.count("_n").alias("docs"), F.avg("_n").alias("avg"), F.min("_n").alias("min"), F.max("_n").alias("max"), quart.alias("quartiles"))


def run_summary(runs: DataFrame) -> DataFrame:
    """runs(model, ok, tokens, seconds) by model and in total."""
    agg = [F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds")]
    return runs.groupingSets([["model"], []], "model").agg(*agg)
