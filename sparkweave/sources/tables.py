"""Keyed tables: insert what is absent, look up in order, update graph attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import graph as G


def row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("_hash", F.md5(F.to_json(F.struct(*sorted(df.columns)))))


def absent(store: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of new whose key the store lacks; the first by order of each key (first write wins)."""
    first = Window.partitionBy(key).orderBy(F.col(order) if order else F.md5(F.to_json(F.struct(*new.columns))))
    new = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return new.join(store.select(key), key, "left_anti").select(new.columns)


def insert_absent(store: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    return store.unionByName(absent(store, new, key, order), allowMissingColumns=True)


def append_new(store: DataFrame, items: DataFrame) -> DataFrame:
    """store and those items that it does not hold; repeats inside items stay."""
    new = row_hash(items).join(row_hash(store.select(items.columns)).select("_hash"), "_hash", "left_anti").drop("_hash")
    return store.unionByName(new)


def appended(store: DataFrame, items: DataFrame, ordinal: str = "ord") -> DataFrame:
    """store and all of items after it, repeats too; ordinal numbers the rows on in the order of items' own."""
    last = store.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("_last"))
    place = G.numbered(items, ordinal)
    return store.unionByName(place.crossJoin(F.broadcast(last)).withColumn(ordinal, F.col("_last") + 1 + F.col("_place")).drop("_last", "_place"))  # one row


def dropped(store: DataFrame) -> DataFrame:
    """The store without its rows; its columns stay."""
    return store.limit(0)


def missing_keys(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return keys.join(store.select(key), key, "left_anti")


def lookup(ids: DataFrame, store: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """ids(pos, key) with the fields of each, null where it is missing, to be read in the order of pos."""
    return ids.join(store.select(key, *fields), key, "left").select("pos", key, *fields)


def all_keys(store: DataFrame, key: str) -> DataFrame:
    return store.select(key)


def at_index(store: DataFrame, ordinal: str, index: int) -> DataFrame:
    return store.filter(F.col(ordinal) == index)


def updated(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the non-null values of changes; new keys are added."""
    names = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = table.join(new, keys, "full")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names and c in table.columns else F.col(f"_new_{c}").alias(c) if c in names else F.col(c) for c in dict.fromkeys([*table.columns, *names])])


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without these nodes and the edges that touch them."""
    nodes = nodes.join(gone, "node_id", "left_anti")
    for end in ("src", "tgt"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    return nodes, edges
