"""Export layouts: chat formats, evaluation formats, flat CSV, reviewed rows, GraphML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

QA_EXTRAS = ("mode", "reasoning_path", "thinking_process", "final_answer", "context", "graph", "source_chunks", "source_documents", "metadata")


def _extras(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in QA_EXTRAS if c in df.columns]


def alpaca(qa: DataFrame) -> DataFrame:
    return qa.select(F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"), *_extras(qa))


def _turns(speaker: str, text: str, roles) -> Column:
    return F.array(*[F.struct(F.lit(r).alias(speaker), F.col(c).alias(text)) for r, c in zip(roles, ("question", "answer"))])


def sharegpt(qa: DataFrame) -> DataFrame:
    return qa.select(_turns("from", "value", ("human", "gpt")).alias("conversations"), *_extras(qa))


def chatml(qa: DataFrame) -> DataFrame:
    return qa.select(_turns("role", "content", ("user", "assistant")).alias("messages"), *_extras(qa))


def benchmark_items(items: DataFrame) -> DataFrame:
    return items.select("id", "type", "difficulty", "question", "reference_answer", *[c for c in ("evaluation_criteria", "metadata") if c in items.columns])


def qa_pairs(items: DataFrame) -> DataFrame:
    return items.select("id", "question", F.col("reference_answer").alias("answer"), "type", "difficulty")


def multiple_choice(items: DataFrame) -> DataFrame:
    """Options are the answer and the distractors; rows without distractors go."""
    options = F.concat(F.array("reference_answer"), F.col("distractors"))
    return items.filter(F.size("distractors") > 0).select("id", "question", options.alias("options"), F.lit(0).alias("correct"), "difficulty")


def flat(df: DataFrame, base: list[str], optional: list[str]) -> DataFrame:
    """Text columns only: nested values as JSON, nulls as ''; missing base columns are ''; missing optional ones are left out."""

    def one(c: str) -> Column:
        if c not in df.columns:
            return F.lit("").alias(c)
        nested = isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit("")).alias(c)

    return df.select(*map(one, base), *[one(c) for c in optional if c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quoteAll=True, escape='"', mode="overwrite")


def reviewed(items: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Reviewed rows: modified content wins; its fields beside the review columns.  None or ['all'] keeps every status."""
    rows = items if statuses is None or "all" in statuses else items.filter(F.col("review_status").isin(statuses))
    content = F.coalesce("modified_content", "content")
    return rows.select("item_id", content.alias("c"), "review_status", "review_comment", "reviewer", "review_time").select("item_id", "c.*", "review_status", "review_comment", "reviewer", "review_time")


def file_metrics(scores: DataFrame, path: str | None = None) -> DataFrame:
    """Per input file: rows, and mean, least and greatest of each numeric column."""
    numbers = [f.name for f in scores.schema if isinstance(f.dataType, T.NumericType)]
    out = scores.groupBy("input_file").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    if path:
        write_csv(out, path)
    return out


#: Elements in a GraphML part file at most: readers take an XML file whole in one task.
FILE_ELEMENTS = 100_000


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge elements as XML part files below path, of FILE_ELEMENTS at most; attributes are map<key, text>."""
    data = F.transform(F.map_entries("attributes"), lambda x: F.struct(x["key"].alias("_key"), x["value"].alias("_VALUE")))
    write = lambda rows, tag: rows.write.format("xml").option("rowTag", tag).option("rootTag", "graph").option("maxRecordsPerFile", FILE_ELEMENTS).mode("overwrite").save(f"{path}/{tag}s")
    write(nodes.select(F.col("node_id").alias("_id"), data.alias("data")), "node")
    write(edges.select(F.col("src").alias("_source"), F.col("tgt").alias("_target"), data.alias("data")), "edge")
