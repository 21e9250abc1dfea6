"""Flows of several model calls: two-stage atomic pairs, and runs that follow intents until a target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import graph as G
from . import parse, taxonomy
from .extract import filled

QUESTION = "Write one question from the facts.\n{context}"
ANSWER = "Answer the question from the facts.\n{context}\nQuestion: {question}"
INTENT = "Write a question with this intent: {intent}\nFacts:\n{context}"

#: Takes rows with a column prompt and gives them back with response and status.
Respond = Callable[[DataFrame], DataFrame]


def two_stage(batches: DataFrame, respond: Respond, per_batch: int = 1, mode: str = "atomic") -> DataFrame:
    """batches(batch_id, context) -> (batch_id, k, question, answer, status): questions first, answers to distinct ones.

    status: 'ok', 'no_question', 'repeated' (an earlier row has the question) or 'no_answer'; every
    batch and number of question has a row.  Both stages are checkpointed, so no call is made twice.
    """
    G.ensure_checkpoint_dir(batches.sparkSession)
    asked = batches.select("batch_id", "context", F.explode(F.sequence(F.lit(1), F.lit(per_batch))).alias("k"))
    key = F.struct("batch_id", "k")
    first = respond(asked.withColumn("prompt", filled(F.lit(QUESTION), context=F.col("context")))).select(key.alias("id"), "response").checkpoint()
    questions = parse.only_questions(first, "id").withColumn("mode", F.lit(mode))
    fresh = parse.without_repeats(questions, "id").select("id", "question").checkpoint()
    todo = fresh.select("id.*", "question").join(asked, ["batch_id", "k"])
    second = respond(todo.withColumn("prompt", filled(F.lit(ANSWER), context=F.col("context"), question=F.col("question")))).select(key.alias("id"), "response").checkpoint()
    answers = parse.only_answers(second, "id")
    out = asked.select(key.alias("id")).join(questions.select("id", F.col("question").alias("said")), "id", "left").join(fresh, "id", "left").join(answers, "id", "left")
    status = F.when(F.col("said").isNull(), "no_question").when(F.col("question").isNull(), "repeated").when(F.trim(F.coalesce("answer", F.lit(""))) == "", "no_answer").otherwise("ok")
    return out.select("id.*", F.col("said").alias("question"), "answer", status.alias("status"))


def intent_run(tree: DataFrame, nodes: DataFrame, edges: DataFrame, respond: Respond, review: Respond, target: int, seed: int = 0) -> DataFrame:
    """(intent_id, question, answer, score): sampled intents with their neighbourhood, prompted, parsed and reviewed.

    Each round samples what is still wanted among intents not tried yet, until target rows have
    passed, three times the target have been tried, or none is left.  Intents without a linked
    node get the graph's first nodes.  review(rows with prompt) gives a critic's JSON.
    """
    spark = tree.sparkSession
    G.ensure_checkpoint_dir(spark)
    free = taxonomy.with_depth(tree).select("id", "name", "description", "is_leaf").checkpoint()
    kept, n_kept, n_tried = None, 0, 0
    fallback = G.first_nodes(nodes.select("node_id"), edges, 20)[0].agg(F.array_join(F.array_sort(F.collect_list("node_id")), "\n").alias("first"))  # one row, 20 names
    free = taxonomy.in_order(free, seed).limit(max(0, 3 * target)).checkpoint()  # no other intent is ever tried
    every = free.select(F.col("id").alias("intent_id"), F.concat_ws(" ", "name", "description").alias("text"))
    links = G.settled(taxonomy.link_intents(every, nodes))  # nodes are read once a run
    while n_kept < target and n_tried < 3 * target:
        some = taxonomy.in_order(free, seed).limit(min(target - n_kept, 3 * target - n_tried)).checkpoint()
        n = some.count()
        if not n:
            break
        intents = some.select(F.col("id").alias("intent_id"), F.concat_ws(" ", "name", "description").alias("text"))
        about = taxonomy.intent_subgraphs(intents, nodes, edges, links=links).withColumnRenamed("text", "context")
        asked = intents.join(about, "intent_id", "left").crossJoin(F.broadcast(fallback)).withColumn("context", F.coalesce("context", "first"))
        said = respond(asked.withColumn("prompt", filled(F.lit(INTENT), intent=F.col("text"), context=F.col("context")))).select("intent_id", "response").checkpoint()
        pairs = parse.intent_pairs(said, "intent_id")
        judged = review(pairs.withColumn("prompt", F.concat_ws("\n", "question", "answer"))).select("intent_id", "response")
        good = parse.critic_verdicts(judged, "intent_id").filter("passed").select("intent_id", "score")
        got = pairs.join(good, "intent_id").checkpoint()
        kept = got if kept is None else kept.unionByName(got)
        free = free.join(some.select("id"), "id", "left_anti").checkpoint()
        n_kept, n_tried = n_kept + got.count(), n_tried + n
    return kept if kept is not None else spark.createDataFrame([], "intent_id string, question string, answer string, score double")
