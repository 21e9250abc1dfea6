"""Incremental ingest of documents into graph tables, and per-minute request accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import chunking, extract
from ..sources import readers, tables

TABLES = {
    "docs": "doc_id string, type string, content string, ord long",
    "chunks": "chunk_id string, content string, type string, full_doc_id string, length int, language string",
    "entities": "entity_name string, entity_type string, description string, source_id string",
    "relations": "src_id string, tgt_id string, description string, source_id string",
}


class Store:
    """Parquet tables below one folder, a subfolder for each micro-batch: a replayed batch overwrites its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str, before: int | None = None) -> DataFrame:
        try:
            df = self.spark.read.schema(TABLES[name] + ", batch long").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], TABLES[name] + ", batch long")
        return (df if before is None else df.filter(F.col("batch") < before)).drop("batch")

    def write(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = extract.merge_nodes(self.read("entities")), extract.merge_edges(self.read("relations"))
        return extract.with_endpoints(nodes, edges), edges


def ingest_batch(store: Store, docs: DataFrame, batch: int, respond=extract.rule_extraction) -> None:
    """docs(type, content, ord): new documents, then their new chunks, are chunked, extracted and appended."""
    docs = readers.without_blank(docs).withColumn("doc_id", F.concat(F.lit("doc-"), F.md5(F.trim("content"))))
    new = tables.absent(store.read("docs", batch), docs.select("doc_id", "type", "content", F.col("ord").cast("long")), "doc_id", "ord")
    store.write("docs", new, batch)
    new = store.spark.read.schema(TABLES["docs"]).parquet(f"{store.path}/docs/batch={batch}")
    chunks = tables.absent(store.read("chunks", batch), chunking.chunk_documents(new), "chunk_id")
    store.write("chunks", chunks, batch)
    chunks = store.spark.read.schema(TABLES["chunks"]).parquet(f"{store.path}/chunks/batch={batch}")
    entities, relations = extract.mentions(respond(chunks))
    store.write("entities", entities, batch)
    store.write("relations", relations, batch)


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, respond=extract.rule_extraction):
    """A streaming query (available-now) that ingests every new row of stream(type, content, ord)."""
    return stream.writeStream.foreachBatch(lambda df, batch: ingest_batch(store, df, batch, respond)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_minute(log: DataFrame, max_requests: int, max_tokens: int, late: str | None = None) -> DataFrame:
    """log(ts, tokens) -> (minute, requests, tokens, over): works on batches and, with a watermark, on streams."""
    x = log.withWatermark("ts", late) if late else log
    x = x.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return x.select(F.col("w.start").alias("minute"), "requests", "tokens", ((F.col("requests") > max_requests) | (F.col("tokens") > max_tokens)).alias("over"))
