"""Prompt tables: contexts of batches, hierarchy and subgraph texts, templates, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import graph as G
from ..functions import text as T
from .extract import filled

#: (mode, language, variant, template): our own wording, a table that users replace.
TEMPLATES = [
    ("atomic", "en", 0, "Write one question and its answer from the facts.\n{context}"),
    ("atomic", "en", 1, "Ask about a single fact below and answer it.\n{context}"),
    ("atomic", "zh", 0, "根据事实写一个问题和答案。\n{context}"),
    ("atomic_question", "en", 0, "Write one question from the facts.\n{context}"),
    ("aggregated", "en", 0, "Rephrase the facts as one text, then ask about it.\nEntities:\n{entities}\nRelations:\n{relations}"),
    ("aggregated", "zh", 0, "先把事实改写成一段文字，再据此提问。\n实体：\n{entities}\n关系：\n{relations}"),
    ("multi_hop", "en", 0, "Ask a question that needs several of the relations; give answer and reasoning path.\nEntities:\n{entities}\nRelations:\n{relations}"),
    ("cot", "en", 0, "Design a question with a chain of thought.\nEntities:\n{entities}\nRelations:\n{relations}"),
    ("aggregated_question", "en", 0, "Write one question whose answer is this text.\nText:\n{rephrased}"),
    ("aggregated_question", "zh", 0, "写一个以这段文本为答案的问题。\n文本：\n{rephrased}"),
    ("aggregated_combined", "en", 0, "Rephrase the facts as one text and ask one question that it answers, labelled Rephrased Text and Question.\nEntities:\n{entities}\nRelations:\n{relations}"),
    ("aggregated_combined", "zh", 0, "把事实改写成一段文本并写出它所回答的问题，分别标为“改写文本”和“问题”。\n实体：\n{entities}\n关系：\n{relations}"),
    ("cot_answer", "en", 0, "Answer the question by following the steps.\nQuestion: {question}\nSteps: {path}\nEntities:\n{entities}\nRelations:\n{relations}"),
    ("cot_answer", "zh", 0, "按步骤回答问题。\n问题：{question}\n步骤：{path}\n实体：\n{entities}\n关系：\n{relations}"),
    ("cot_combined", "en", 0, "Write a question, the steps that lead to its answer, and the answer.\nEntities:\n{entities}\nRelations:\n{relations}"),
    ("cot_combined", "zh", 0, "写出问题、推理步骤和答案。\n实体：\n{entities}\n关系：\n{relations}"),
    ("hierarchical", "en", 0, "Ask about the siblings of the hierarchy.\n{hierarchy}"),
    ("hierarchical", "en", 1, "Ask what is inherited in the hierarchy.\n{hierarchy}"),
    ("hierarchical", "en", 2, "Ask for the common parent in the hierarchy.\n{hierarchy}"),
    ("hierarchical", "en", 3, "Ask how far apart two members of the hierarchy are.\n{hierarchy}"),
    ("intent", "en", 0, "Write a question with this intent: {intent}\nFacts:\n{context}"),
    ("knowledge_coverage", "en", 0, "Write {difficulty} test items on these facts as JSON.\n{context}"),
    ("reasoning_ability", "en", 0, "Write {difficulty} reasoning items on these facts as JSON.\n{context}"),
    ("factual_accuracy", "en", 0, "Write {difficulty} true-or-false items on these facts as JSON.\n{context}"),
    ("comprehensive", "en", 0, "Write {difficulty} open items on these facts as JSON.\n{context}"),
]


def one_hop(batches: DataFrame) -> DataFrame:
    """Batches cut to an anchor's surroundings: three nodes and three edges at most.

    The anchor is the first node (or the first end of the first edge); edges that touch it stay, then
    nodes that are ends of those edges, the anchor first.
    """
    anchor = F.coalesce(F.try_element_at("nodes", F.lit(1))["node_id"], F.try_element_at("edges", F.lit(1))["src"])
    x = batches.withColumn("a", F.when((F.size("nodes") > 0) | (F.size("edges") > 0), anchor))
    edges = F.slice(F.filter("edges", lambda e: (e["src"] == F.col("a")) | (e["tgt"] == F.col("a"))), 1, 3)
    x = x.withColumn("edges", edges)
    ends = F.array_union(F.array("a"), F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["tgt"]))))
    x = x.withColumn("ends", ends)
    own, rest = F.filter("nodes", lambda n: n["node_id"] == F.col("a")), F.filter("nodes", lambda n: (n["node_id"] != F.col("a")) & F.array_contains(F.col("ends"), n["node_id"]))
    return x.withColumn("nodes", F.slice(F.concat(own, rest), 1, 3)).drop("a", "ends")


def bullets() -> Column:
    """`- node: description` and `- s - t: description` lines of a batch."""
    n = F.transform("nodes", lambda x: F.concat(F.lit("- "), x["node_id"], F.lit(": "), F.coalesce(x["description"], F.lit(""))))
    e = F.transform("edges", lambda x: F.concat(F.lit("- "), x["src"], F.lit(" - "), x["tgt"], F.lit(": "), F.coalesce(x["description"], F.lit(""))))
    return F.array_join(F.concat(n, e), "\n")


def numbered_entities() -> Column:
    return F.array_join(F.transform("nodes", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["node_id"], F.lit(": "), F.coalesce(x["description"], F.lit("")))), "\n")


def numbered_relations() -> Column:
    return F.array_join(F.transform("edges", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["src"], F.lit(" -- "), x["tgt"], F.lit(": "), F.coalesce(x["description"], F.lit("")))), "\n")


def subgraph_json() -> Column:
    return F.to_json(F.struct("nodes", "edges"))


def hierarchy_text(nodes: DataFrame, edges: DataFrame, layout: str = "markdown", reverse: bool = False) -> DataFrame:
    """nodes(batch_id, node_id, description), edges(batch_id, src, tgt) -> (batch_id, text): trees in pre-order.

    A child is the target of an edge (the source if reverse); children come in order of id; roots have
    no parent; a node that is reached again on its own path is not entered; members of cycles without
    a root are listed at the end.  layout: markdown headings, an outline of dashes, or JSON lines.
    """
    G.ensure_checkpoint_dir(nodes.sparkSession)
    a, b = ("tgt", "src") if reverse else ("src", "tgt")
    e = edges.select("batch_id", F.col(a).alias("parent"), F.col(b).alias("child")).filter("parent <> child").distinct()
    every = nodes.select("batch_id", "node_id").unionByName(e.select("batch_id", F.explode(F.array("parent", "child")).alias("node_id"))).distinct()
    level = every.join(e.select("batch_id", F.col("child").alias("node_id")).distinct(), ["batch_id", "node_id"], "left_anti").withColumn("path", F.array("node_id"))
    out = level
    while True:  # no path meets a node twice
        level = level.join(e, (level["batch_id"] == e["batch_id"]) & (level["node_id"] == e["parent"])).filter(~F.array_contains("path", F.col("child"))).select(level["batch_id"], F.col("child").alias("node_id"), F.array_append("path", F.col("child")).alias("path")).checkpoint()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    lost = every.join(out.select("batch_id", "node_id").distinct(), ["batch_id", "node_id"], "left_anti").withColumn("path", F.array(F.lit("￿"), F.col("node_id")))
    x = out.unionByName(lost).join(nodes.select("batch_id", "node_id", "description"), ["batch_id", "node_id"], "left")
    depth, about = F.size("path"), F.coalesce("description", F.lit(""))
    line = {
        "markdown": F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "), F.col("node_id"), F.when(about != "", F.concat(F.lit("\n"), about)).otherwise("")),
        "outline": F.concat(F.repeat(F.lit("  "), depth - 1), F.lit("- "), F.col("node_id"), F.when(about != "", F.concat(F.lit(": "), about)).otherwise("")),
        "json": F.to_json(F.struct("path", "description")),
    }[layout]
    return x.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda y: y["line"]), "\n").alias("text"))


def mode_prompts(batches: DataFrame, mode: str, seed: int = 0, hierarchy: DataFrame | None = None, rows=TEMPLATES, **values: Column) -> DataFrame:
    """(batch_id, mode, language, prompt): the template by mode and language (English if it lacks one), a variant by seeded hash."""
    spark = batches.sparkSession
    t = spark.createDataFrame([r for r in rows if r[0] == mode], "mode string, language string, variant int, template string")
    have = [r[1] for r in rows if r[0] == mode]
    x = batches.withColumn("context", bullets())
    found = T.main_language("context")
    x = x.withColumn("language", F.when(found.isin(*set(have)), found).otherwise("en"))
    n = F.broadcast(t.groupBy("language").agg(F.count("*").alias("n")))  # a row per language
    x = x.join(n, "language").withColumn("variant", F.pmod(F.xxhash64(F.lit(seed), "batch_id"), F.col("n")).cast("int"))
    x = x.join(F.broadcast(t), ["language", "variant"])  # our template table
    text = F.lit("")
    if hierarchy is not None:
        x = x.join(hierarchy.withColumnRenamed("text", "_h"), "batch_id", "left")
        text = F.col("_h")
    prompt = filled(F.col("template"), context=F.col("context"), entities=numbered_entities(), relations=numbered_relations(), hierarchy=text, **values)
    return x.select("batch_id", "mode", "language", prompt.alias("prompt"))


EVAL_TYPES = ("knowledge_coverage", "reasoning_ability", "factual_accuracy", "comprehensive")


#: (type, difficulty, guidance): what an item of that difficulty asks for; our own wording, a table that users replace.
GUIDANCE = [
    ("knowledge_coverage", "easy", "Ask for one stated fact."),
    ("knowledge_coverage", "medium", "Ask for a fact together with what it depends on."),
    ("knowledge_coverage", "hard", "Ask for details that are easily overlooked, from several facts."),
    ("reasoning_ability", "easy", "One step from a fact to the answer."),
    ("reasoning_ability", "medium", "Two or three steps over different relations."),
    ("reasoning_ability", "hard", "Four steps or more, with a condition that rules out a tempting answer."),
    ("factual_accuracy", "easy", "A statement that plainly agrees or disagrees with a fact."),
    ("factual_accuracy", "medium", "A statement with one changed detail."),
    ("factual_accuracy", "hard", "A statement that is true only in part, or only under a condition."),
    ("comprehensive", "easy", "Summarise what the facts say of one entity."),
    ("comprehensive", "medium", "Compare two entities by their relations."),
    ("comprehensive", "hard", "Judge the facts as a whole and give reasons."),
]


def eval_prompts(planned: DataFrame, batches: DataFrame, guidance=GUIDANCE, counts: bool = False) -> DataFrame:
    """planned(type, difficulty, batch_id[, count]) -> (type, difficulty, batch_id, prompt), with the guidance of its type and difficulty.

    counts: the prompt asks for `count` items.  Pairs without guidance have the level's name alone.
    """
    spark = batches.sparkSession
    t = F.broadcast(spark.createDataFrame([(r[0], r[3]) for r in TEMPLATES if r[0] in EVAL_TYPES], "type string, template string"))
    g = F.broadcast(spark.createDataFrame(guidance, "type string, difficulty string, guidance string"))  # a row a type and level
    x = planned.join(batches, "batch_id").join(t, "type").join(g, ["type", "difficulty"], "left")
    text = filled(F.col("template"), context=bullets(), difficulty=F.col("difficulty"))
    lines = F.concat_ws("\n", text, F.col("guidance"), *([F.concat(F.lit("Items: "), F.col("count").cast("string"))] if counts else []))
    return x.select("type", "difficulty", "batch_id", lines.alias("prompt"))


def repeated_to(batches: DataFrame, target: int, per_batch: float = 1.0, buffer: float = 1.5) -> DataFrame:
    """Batches cycled or cut so that target items, with a buffer, can be expected; adds turn."""
    need = max(1, -(-int(target * buffer) // max(1, int(per_batch))))
    n = batches.count()
    turns = max(1, -(-need // max(1, n)))
    x = batches.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    return x.orderBy("turn", "batch_id").limit(need)


def mode_targets(ratios: dict[str, float], target: int) -> dict[str, int]:
    """Items per mode: negative ratios are 0, all zero are equal, shares rounded down."""
    r = {k: max(0.0, v) for k, v in ratios.items()}
    total = sum(r.values())
    return {k: int(target * (v / total if total else 1 / len(r))) for k, v in r.items()} if r else {}


def batches_by_mode(batches: DataFrame, ratios: dict[str, float], target: int, buffer: float = 1.3) -> DataFrame:
    """(mode, batch_id, ...): the first batches by id for each mode, as many as its target with buffer, none for 0."""
    need = [(m, int(n * buffer)) for m, n in mode_targets(ratios, target).items() if n > 0]
    if not need:
        return batches.limit(0).withColumn("mode", F.lit(""))
    most = max(n for _, n in need)
    first = batches.orderBy("batch_id").limit(most).withColumn("_r", F.row_number().over(Window.orderBy("batch_id")))  # at most `target` rows
    modes = F.broadcast(batches.sparkSession.createDataFrame(need, "mode string, need int"))
    return first.join(modes, F.col("_r") <= F.col("need")).drop("_r", "need")
