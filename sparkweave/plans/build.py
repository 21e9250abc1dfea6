"""Documents to graph: chunk, extract by rule or by a supplied backend, merge, back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import graph as G
from ..operators import chunking, extract, mentions


def documents_of(table: DataFrame) -> DataFrame:
    """(doc_id, type, content, ord) of the documents table."""
    return table.select(F.col("doc_id"), F.lit("text").alias("type"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))


def build_graph(docs: DataFrame, respond=extract.rule_extraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, nodes, edges); respond(chunks) -> (chunk_id, response).

    Responses are written once (a model is asked once), and so are the mentions and edges that several tables derive from.
    """
    G.ensure_checkpoint_dir(docs.sparkSession)
    chunks = chunking.chunk_documents(docs)
    entities, relations = extract.mentions(respond(chunks).checkpoint())
    nodes, edges = extract.merge_nodes(entities).checkpoint(), extract.merge_edges(relations).checkpoint()
    return chunks, extract.with_endpoints(nodes, edges), edges


def build_tables(docs: DataFrame, respond=extract.rule_extraction) -> tuple[DataFrame, mentions.GraphTables]:
    """(chunks, the graph in long form): no row holds all sources or texts of an entity."""
    G.ensure_checkpoint_dir(docs.sparkSession)
    chunks = chunking.chunk_documents(docs)
    entities, relations = extract.mentions(G.settled(respond(chunks)))
    return chunks, mentions.graph_tables(entities, relations)


def top_entities(docs: DataFrame, n: int = 20) -> DataFrame:
    """The entities that occur in most chunks, with their degree."""
    _, x = build_tables(docs)
    x = x.nodes.select("node_id", "entity_type", F.col("sources").alias("occurrences")).join(G.degrees(x.edges), "node_id", "left").na.fill(0, ["degree"])
    return x.orderBy(F.desc("occurrences"), "node_id").limit(n)
