"""Merged mentions as long tables: no row holds all sources or texts of an entity.

A graph is five tables: nodes(node_id, entity_type, mentions, sources, source_sketch), their texts
(node_id, description) and sources (node_id, source_id), and the same of edges.  Every aggregate is
one that tasks begin and merge (counts, minima, distinct-count sketches), and distinct pairs are
spread by both of their columns, so an entity that every chunk names costs a task no more than another.
Tables of two batches merge without the mentions that made them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from .. import graph as G


def _pairs(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    return x.select(*keys, value).filter(F.col(value).isNotNull()).distinct()


def winner(votes: DataFrame) -> DataFrame:
    """(node_id, entity_type, mentions): the commonest type, ties by the smaller name."""
    return votes.groupBy("node_id").agg(F.min_by("entity_type", F.struct(-F.col("votes"), F.col("entity_type"))).alias("entity_type"), F.sum("votes").alias("mentions"))


def _counted(x: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame:
    """Exact and sketched numbers of distinct sources; the sketch merges with those of other batches."""
    return sources.groupBy(*keys).agg(F.count("*").alias("sources"), F.hll_sketch_agg("source_id").alias("source_sketch"))


class GraphTables:
    """A graph in long form, from mentions that are written already; a table is made when it is asked for, and only then."""

    def __init__(self, entities: DataFrame, relations: DataFrame):
        self._e, self._r, self._keys = entities, relations, ["src", "tgt"]

    @cached_property
    def _named(self) -> DataFrame:
        return G.settled(self._e.groupBy("node_id", "entity_type").agg(F.count("*").alias("votes")))

    @cached_property
    def _every(self) -> DataFrame:
        """Texts and sources of entities, and of their relations for ends that no entity names."""
        ends = self._r.select(F.explode(F.array("src", "tgt")).alias("node_id"), "description", "source_id")
        return self._e.select("node_id", "description", "source_id").unionByName(ends.join(self._named.select("node_id").distinct(), "node_id", "left_anti"))

    @cached_property
    def node_types(self) -> DataFrame:
        """(node_id, entity_type, votes)"""
        ends = self._r.select(F.explode(F.array("src", "tgt")).alias("node_id")).distinct().join(self._named.select("node_id"), "node_id", "left_anti")
        return G.settled(self._named.unionByName(ends.select("node_id", F.lit("UNKNOWN").alias("entity_type"), F.lit(0).cast("long").alias("votes"))))

    @cached_property
    def node_texts(self) -> DataFrame:
        return _pairs(self._every, ["node_id"], "description")

    @cached_property
    def node_sources(self) -> DataFrame:
        return _pairs(self._every, ["node_id"], "source_id")

    @cached_property
    def nodes(self) -> DataFrame:
        return winner(self.node_types).join(_counted(self._every, ["node_id"], self.node_sources), "node_id", "left").na.fill(0, ["sources"])

    @cached_property
    def edges(self) -> DataFrame:
        """(src, tgt, mentions, sources, source_sketch)"""
        return self._r.groupBy(*self._keys).agg(F.count("*").alias("mentions")).join(_counted(self._r, self._keys, self.edge_sources), self._keys, "left").na.fill(0, ["sources"])

    @cached_property
    def edge_texts(self) -> DataFrame:
        return _pairs(self._r, self._keys, "description")

    @cached_property
    def edge_sources(self) -> DataFrame:
        return _pairs(self._r, self._keys, "source_id")


def graph_tables(entities: DataFrame, relations: DataFrame) -> GraphTables:
    """entities(entity_name, entity_type, description, source_id), relations(src_id, tgt_id, description, source_id).

    Ends of relations that no entity names become UNKNOWN nodes with the texts and sources of their
    relations.  An edge joins src < tgt.  Null descriptions and sources are no texts and no sources.
    """
    G.ensure_checkpoint_dir(entities.sparkSession)
    e = entities.select(F.col("entity_name").alias("node_id"), "entity_type", "description", F.col("source_id").cast("string").alias("source_id"))
    r = relations.select(F.least("src_id", "tgt_id").alias("src"), F.greatest("src_id", "tgt_id").alias("tgt"), "description", F.col("source_id").cast("string").alias("source_id"))
    return GraphTables(e, r)


def merged_nodes(a: DataFrame, b: DataFrame, votes: DataFrame) -> DataFrame:
    """Nodes of two batches as one: types from the votes of both, sources by the union of the sketches (an estimate)."""
    x = a.select("node_id", "source_sketch").unionByName(b.select("node_id", "source_sketch")).filter("source_sketch is not null")
    s = x.groupBy("node_id").agg(F.hll_union_agg("source_sketch").alias("source_sketch"))
    types = winner(votes.groupBy("node_id", "entity_type").agg(F.sum("votes").alias("votes")))
    known = types.join(s, "node_id", "left")
    return known.select("node_id", "entity_type", "mentions", F.coalesce(F.hll_sketch_estimate("source_sketch"), F.lit(0)).cast("long").alias("sources"), "source_sketch")


def adjacency_pages(edges: DataFrame, page: int = 1000) -> DataFrame:
    """edges(src, tgt) -> (node_id, page, pages, neighbours): a node's distinct neighbours, about `page` in each row.

    A hub has many rows: its neighbours are dealt by their hash to as many pages as it needs.
    """
    both = G.both_ways(edges).filter("u is not null and v is not null").distinct()
    pages = both.groupBy("u").agg(F.ceil(F.count("*") / page).alias("pages"))
    big = pages.filter("pages > 1")  # few: a node of this table has over `page` edges
    x = both.join(big, "u", "left").na.fill(1, ["pages"]).withColumn("page", F.pmod(F.xxhash64("v"), F.col("pages")))
    return x.groupBy(F.col("u").alias("node_id"), "page", "pages").agg(F.array_sort(F.collect_list("v")).alias("neighbours"))


def gathered(table: DataFrame, keys: list[str], value: str, sep: str = "<SEP>", most: int | None = None) -> DataFrame:
    """keys and the distinct values joined in order, for layouts that ask for one text; most: the first values only."""
    x = table.select(*keys, value).distinct()
    if most is not None:
        from pyspark.sql import Window

        x = x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_n") <= most)
    return x.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias(value))


def occurrences(sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, occurrences) from a long table of distinct sources."""
    return sources.groupBy(*keys).agg(F.count("*").alias("occurrences"))


def token_total(texts: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, tokens) of all texts of each key, without joining them."""
    return texts.groupBy(*keys).agg(F.sum(tokens).alias("tokens"))
