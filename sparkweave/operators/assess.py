"""Comprehension assessment: statements about descriptions, judgements, losses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .extract import filled

#: The loss of a unit that could not be judged.
DEFAULT_LOSS = -math.log(0.1)
STATEMENT_TEMPLATES = [("yes", "Restate without changing the meaning:\n{text}"), ("no", "Restate so that it becomes false:\n{text}")]
JUDGE_TEMPLATE = "Is this statement true? Answer yes or no.\n{text}"


def descriptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("description").unionByName(edges.select("description")).filter("trim(coalesce(description, '')) <> ''").distinct()


def statement_prompts(nodes: DataFrame, edges: DataFrame, samples: int, done: DataFrame | None = None) -> DataFrame:
    """(description, gt, k, prompt): per description `samples` false ones and `samples` - 1 true ones, besides the description itself."""
    d = descriptions(nodes, edges)
    if done is not None:
        d = d.join(done.select("description"), "description", "left_anti")
    t = F.broadcast(d.sparkSession.createDataFrame(STATEMENT_TEMPLATES, "gt string, template string"))  # two rows
    x = d.crossJoin(t).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples)))).filter(~((F.col("gt") == "yes") & (F.col("k") == samples)))
    return x.select("description", "gt", "k", filled(F.col("template"), text=F.col("description")).alias("prompt"))


def statements(descs: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct (description, statement, gt): each description is a true statement about itself."""
    own = descs.select("description", F.col("description").alias("statement"), F.lit("yes").alias("gt"))
    return own.unionByName(answers.select("description", F.col("response").alias("statement"), "gt")).filter("trim(coalesce(statement, '')) <> ''").dropDuplicates(["description", "statement", "gt"])


def judge_prompts(units: DataFrame, stmts: DataFrame, re_judge: bool = False) -> DataFrame:
    """units(unit_id, description, loss) -> (unit_id, statement, gt, prompt) for units without a loss."""
    todo = units if re_judge else units.filter("loss is null")
    return todo.join(stmts, "description").select("unit_id", "statement", "gt", filled(F.lit(JUDGE_TEMPLATE), text=F.col("statement")).alias("prompt"))


def losses(judged: DataFrame, units: DataFrame | None = None, case_sensitive: bool = True, entropy: bool = True) -> DataFrame:
    """judged(unit_id, gt, token, prob) -> (unit_id, loss): cross entropy (or linear) of the first token, mean by unit.

    A unit with any token besides yes and no, with a probability that has no logarithm, or
    without judgements gets DEFAULT_LOSS.
    """
    token = F.col("token") if case_sensitive else F.lower("token")
    right = token == F.col("gt")
    p, q = F.col("prob"), 1 - F.col("prob")
    one = F.when(right, -F.ln(p)).otherwise(-F.ln(q)) if entropy else F.when(right, q).otherwise(p)
    odd = ~F.lower("token").isin("yes", "no") | F.col("token").isNull() | p.isNull()
    if entropy:
        odd = odd | F.when(right, p <= 0).otherwise(q <= 0)
    out = judged.groupBy("unit_id").agg(F.avg(one).alias("loss"), F.max(F.coalesce(odd, F.lit(True)).cast("int")).alias("odd"))
    out = out.select("unit_id", F.when(F.col("odd") == 1, DEFAULT_LOSS).otherwise(F.coalesce("loss", F.lit(DEFAULT_LOSS))).alias("loss"))
    if units is not None:
        out = units.select("unit_id").join(out, "unit_id", "left").select("unit_id", F.coalesce("loss", F.lit(DEFAULT_LOSS)).alias("loss"))
    return out


def mean_loss(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("loss").alias("mean_loss"), F.count("loss").alias("judged"))
