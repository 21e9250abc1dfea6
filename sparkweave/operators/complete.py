"""The model-call boundary: prompts in, responses out, with a cache and usage totals."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .extract import filled

RESULT = "response string, status string, attempts int, error string, prompt_tokens long, completion_tokens long"


def prompt_key(df: DataFrame, params: dict | None = None) -> Column:
    """sha256 over the prompt, its history and the sampling parameters."""
    extra = [F.lit(f"{k}={v}") for k, v in sorted((params or {}).items())]
    history = F.to_json("history") if "history" in df.columns else F.lit("")
    return F.sha2(F.to_json(F.array(F.col("prompt"), history, *extra)), 256)


def complete(prompts: DataFrame, backend: Callable[[list[str]], list[str]], retries: int = 2) -> DataFrame:
    """prompts(..., prompt) with response, status ('ok', 'empty', 'failed'), attempts and token usage.

    backend takes and returns a batch of texts; it runs on the executors, once per Arrow batch, and
    again for prompts without an answer.  A batch that raises is tried again and then marked failed.
    """
    ddl = StructType.fromDDL
    names = prompts.columns

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            out, status, tries, why = [""] * n, ["failed"] * n, [0] * n, [None] * n
            todo = list(range(n))
            for _ in range(retries + 1):
                if not todo:
                    break
                for i in todo:
                    tries[i] += 1
                try:
                    got = backend([pdf["prompt"].iloc[i] for i in todo])
                except Exception as e:  # a backend's failure is a row's status
                    for i in todo:
                        why[i] = f"{type(e).__name__}: {e}"
                    continue
                for i, text in zip(todo, got):
                    out[i], status[i], why[i] = text or "", "ok" if text and text.strip() else "empty", None
                todo = [i for i in todo if status[i] != "ok"]
            words = lambda xs: [len((x or "").split()) for x in xs]
            yield pdf.assign(response=out, status=status, attempts=pd.array(tries, "int32"), error=pd.array(why, "string"), prompt_tokens=words(pdf["prompt"]), completion_tokens=words(out))

    schema = StructType([*prompts.schema.fields, *[f for f in ddl(RESULT).fields if f.name not in names]])
    return prompts.mapInPandas(run, schema)


def from_table(prompts: DataFrame, responses: DataFrame, params: dict | None = None) -> DataFrame:
    """Responses from a table keyed by prompt_key; status 'missing' where it lacks one."""
    x = prompts.withColumn("key", prompt_key(prompts, params)).join(responses.select("key", "response"), "key", "left")
    return x.withColumn("status", F.when(F.col("response").isNull(), "missing").otherwise("ok")).drop("key")


def with_cache(prompts: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with response, distinct misses): cache(key, response, ts); entries older than the time to live do not count."""
    x = prompts.withColumn("key", prompt_key(prompts, params))
    fresh = cache.filter(F.col("ts").cast("long") >= now.cast("timestamp").cast("long") - ttl_seconds)
    return x.join(fresh.select("key", "response"), "key"), x.join(fresh.select("key"), "key", "left_anti").dropDuplicates(["key"])


def retained(cache: DataFrame, most: int) -> DataFrame:
    """The newest entries of a cache."""
    return cache.orderBy(F.desc("ts"), "key").limit(most)


def scored(pairs: DataFrame, scorer: Callable[[list[str]], list[float]], template: str = "question: {question} answer: {answer}") -> DataFrame:
    """Adds score from a batch callable over input strings built from columns."""
    x = pairs.withColumn("_in", filled(F.lit(template), question=F.col("question"), answer=F.col("answer")))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(score=[float(s) for s in scorer(pdf["_in"].tolist())])

    return x.mapInPandas(run, StructType([*x.schema.fields, *StructType.fromDDL("score double").fields])).drop("_in")


def score_summary(df: DataFrame, column: str = "score") -> DataFrame:
    return df.agg(F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max"))


def usage_totals(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    return usage.groupBy(*(by or [])).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
