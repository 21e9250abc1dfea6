"""Incremental graphs as keyed state: a batch reads and writes the keys that it touches.

documents -> distinct documents -> chunks -> distinct chunks -> responses -> mentions
mentions  -> votes, texts and sources by key, and the nodes and edges that changed

Both are streaming queries whose state (the hashes of documents and chunks seen, the counts of each
entity) is partitioned by key in the state store, with RocksDB where the session says so.  What a
trigger appends is its own mentions, new texts, new sources, and a row for each node or edge that
changed, with the trigger's number; nothing reads the tables that hold the graph.  A reader takes the last
row of a key; compacted() does the same once for all readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunking, extract

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MENTION = "kind string, a string, b string, description string, source_id string"
TABLES = {
    "chunks": "chunk_id string, content string, type string, full_doc_id string, length int, language string",
    "mentions": MENTION,
    "votes": "node_id string, entity_type string, votes long",
    "node_texts": "node_id string, description string",
    "node_sources": "node_id string, source_id string",
    "edge_counts": "src string, tgt string, mentions long",
    "edge_texts": "src string, tgt string, description string",
    "edge_sources": "src string, tgt string, source_id string",
}


def state_conf(spark: SparkSession, partitions: int | None = None) -> None:
    """State in RocksDB with changelogs: what a trigger writes is what it changed.  partitions is fixed for the life of a checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


class GraphStore:
    """Parquet tables below one folder, a subfolder for each trigger; a replayed trigger overwrites its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        """All rows of a table, with the number of their trigger."""
        schema = TABLES[name] + ", batch long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self.exists(name) else self.spark.createDataFrame([], schema)

    def stream(self, name: str) -> DataFrame:
        """The rows of a table as they come; triggers write it whole, so its files never change."""
        return self.spark.readStream.schema(TABLES[name] + ", batch long").parquet(f"{self.path}/{name}").drop("batch")

    def last(self, name: str, keys: list[str], value: str) -> DataFrame:
        """The last row of each key."""
        return self.read(name).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))

    def nodes(self) -> DataFrame:
        """(node_id, entity_type, mentions): the commonest type, ties by the smaller name; UNKNOWN where only edges name it."""
        v = self.last("votes", ["node_id", "entity_type"], "votes")
        x = v.groupBy("node_id").agg(F.min_by("entity_type", F.struct(-F.col("votes"), F.col("entity_type"))).alias("entity_type"), F.sum("votes").alias("mentions"))
        ends = self.read("edge_counts").select(F.explode(F.array("src", "tgt")).alias("node_id")).distinct().join(x.select("node_id"), "node_id", "left_anti")
        return x.unionByName(ends.select("node_id", F.lit("UNKNOWN").alias("entity_type"), F.lit(0).cast("long").alias("mentions")))

    def edges(self) -> DataFrame:
        return self.last("edge_counts", ["src", "tgt"], "mentions")

    def compacted(self, path: str) -> None:
        """The votes and edge counts of today, a row a key, as tables of another folder."""
        other = GraphStore(self.spark, path)
        other.write("votes", self.last("votes", ["node_id", "entity_type"], "votes"), 0)
        other.write("edge_counts", self.edges(), 0)
        for name in ("node_texts", "node_sources", "edge_texts", "edge_sources"):
            other.write(name, self.read(name).drop("batch"), 0)


def mention_rows(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Mentions of both kinds in one layout: an entity's name and type, or the ordered ends of a relation."""
    e = entities.select(F.lit("entity").alias("kind"), F.col("entity_name").alias("a"), F.col("entity_type").alias("b"), "description", F.col("source_id").cast("string").alias("source_id"))
    r = relations.select(F.lit("relation").alias("kind"), F.least("src_id", "tgt_id").alias("a"), F.greatest("src_id", "tgt_id").alias("b"), "description", F.col("source_id").cast("string").alias("source_id"))
    return e.unionByName(r)


def new_documents(stream: DataFrame) -> DataFrame:
    """stream(content, ...) -> (doc_id, content, type): documents never seen before, blank ones dropped."""
    docs = stream.filter("trim(coalesce(content, '')) <> ''").select(F.concat(F.lit("doc-"), F.md5(F.trim("content"))).alias("doc_id"), F.lit("text").alias("type"), "content")
    return docs.dropDuplicates(["doc_id"])


def _query(x: DataFrame, checkpoint: str, name: str, one: Callable[[DataFrame, int], None], mode: str = "append"):
    return x.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()


def ingest_documents(stream: DataFrame, store: GraphStore, checkpoint: str):
    """A query (available now) from stream(content) to the store's chunks; a document is chunked once."""

    def one(df: DataFrame, batch: int) -> None:
        store.write("chunks", chunking.chunk_documents(df.withColumn("ord", F.xxhash64("doc_id"))), batch)

    return _query(new_documents(stream), checkpoint, "documents", one)


def extract_chunks(store: GraphStore, checkpoint: str, respond: Callable[[DataFrame], DataFrame] = extract.rule_extraction):
    """A query (available now) from the store's chunks to its mentions; a chunk is asked once, whichever documents hold it.

    respond(chunks) -> (chunk_id, response) gets a trigger's new chunks as a plain table, so it may join or call a model.
    """

    def one(df: DataFrame, batch: int) -> None:
        store.write("mentions", mention_rows(*extract.mentions(respond(df), bare_names=True)), batch)

    return _query(store.stream("chunks").dropDuplicates(["chunk_id"]), checkpoint, "chunks", one)


def merge_mentions(store: GraphStore, checkpoint: str) -> list:
    """Queries (available now) from the store's mentions to its other tables, each with state of its own.

    Counts go on by key and only changed keys are written; texts and sources are written once.
    """
    stream = store.stream("mentions")
    entity, relation = stream.filter("kind = 'entity'"), stream.filter("kind = 'relation'")
    node = F.col("a").alias("node_id")
    ends = [F.col("a").alias("src"), F.col("b").alias("tgt")]
    named = relation.select(F.explode(F.array("a", "b")).alias("a"), "description", "source_id").unionByName(entity.select("a", "description", "source_id"))
    flows = {
        "votes": (entity.groupBy(node, F.col("b").alias("entity_type")).agg(F.count("*").alias("votes")), "update"),
        "edge_counts": (relation.groupBy(*ends).agg(F.count("*").alias("mentions")), "update"),
        "node_texts": (named.filter("description is not null").select(node, "description").dropDuplicates(["node_id", "description"]), "append"),
        "node_sources": (named.select(node, "source_id").dropDuplicates(["node_id", "source_id"]), "append"),
        "edge_texts": (relation.filter("description is not null").select(*ends, "description").dropDuplicates(["src", "tgt", "description"]), "append"),
        "edge_sources": (relation.select(*ends, "source_id").dropDuplicates(["src", "tgt", "source_id"]), "append"),
    }
    return [_query(x, checkpoint, name, lambda df, batch, name=name: store.write(name, df, batch), mode) for name, (x, mode) in flows.items()]


def run(stream: DataFrame, store: GraphStore, checkpoint: str, respond: Callable[[DataFrame], DataFrame] = extract.rule_extraction) -> list:
    """All steps once, for what has come since the last run; returns the finished queries."""
    done = [ingest_documents(stream, store, checkpoint)]
    done[0].awaitTermination()
    if store.exists("chunks"):
        done.append(extract_chunks(store, checkpoint, respond))
        done[1].awaitTermination()
        done += merge_mentions(store, checkpoint)
        for q in done[2:]:
            q.awaitTermination()
    return done
