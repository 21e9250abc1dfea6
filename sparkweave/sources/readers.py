"""Readers: text, Markdown, JSON, JSONL, CSV, parser output, QA folders, review items, GraphML, taxonomies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import graph as G

SUFFIXES = ("txt", "md", "markdown", "json", "jsonl", "csv")


def _with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.col("_metadata.file_path"))


def read_text(spark: SparkSession, path) -> DataFrame:
    """One document per file: (type, content, path)."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt") if isinstance(path, str) and "." not in path.rsplit("/", 1)[-1] else spark.read.text(path, wholetext=True)
    return _with_path(raw).select(F.lit("text").alias("type"), F.col("value").alias("content"), "path")


def read_markdown(spark: SparkSession, path) -> DataFrame:
    """As read_text; bytes that are not UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").load(path)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    content = F.when(good, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(F.lit("text").alias("type"), content.alias("content"), "path")


def read_json(spark: SparkSession, path) -> DataFrame:
    """A file holds a list of objects."""
    return _with_path(spark.read.json(path, multiLine=True))


def read_jsonl(spark: SparkSession, path, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines that do not parse are kept apart with their text."""
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    lines = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    bad = lines.filter("v is null").select("value", "path")
    if schema is None:
        schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType())])
    good = lines.filter("v is not null").select(F.from_json("value", schema).alias("r"), "path").select("r.*", "path")
    return good, bad


def read_csv(spark: SparkSession, path) -> DataFrame:
    return _with_path(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of any known suffix as one table, one read for all files of a suffix; unknown suffixes are refused."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        suffix = p.rsplit(".", 1)[-1].lower()
        if suffix not in SUFFIXES:
            raise ValueError(f"unknown suffix: {p}")
        groups.setdefault(suffix, []).append(p)
    out = None
    for suffix, same in groups.items():
        df = {"txt": read_text, "md": read_markdown, "markdown": read_markdown, "json": read_json, "jsonl": lambda s, x: read_jsonl(s, x)[0], "csv": read_csv}[suffix](spark, same)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_folder(spark: SparkSession, folder: str, suffix: str, recursive: bool = False) -> DataFrame:
    """All files of one suffix in a folder (and below)."""
    reader = spark.read.option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", recursive)
    if suffix in ("txt", "md"):
        return _with_path(reader.text(folder, wholetext=True)).select(F.lit("text").alias("type"), F.col("value").alias("content"), "path")
    return _with_path(reader.json(folder, multiLine=suffix == "json") if suffix != "csv" else reader.csv(folder, header=True, multiLine=True, escape='"'))


def read_parser_output(spark: SparkSession, path) -> DataFrame:
    """A PDF parser's content list: text becomes content, image paths are resolved beside the file."""
    df = _with_path(spark.read.json(path, multiLine=True))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    for c in ("img_path", "table_img_path", "equation_img_path"):
        if c in df.columns:
            df = df.withColumn(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(folder, F.lit("/"), F.col(c))))
    if "text" in df.columns:
        df = df.withColumnRenamed("text", "content")
    return df.drop("page_idx", "bbox", "text_level")


def checked(docs: DataFrame, column: str = "content") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): rows of type text need the text column."""
    if column not in docs.columns:
        raise ValueError(f"no column {column}")
    bad = (F.col("type") == "text") & F.col(column).isNull()
    return docs.filter(~F.coalesce(bad, F.lit(False))), docs.filter(bad)


def without_blank(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("type") != "text") | (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0))


def _plain(path: str):
    return F.regexp_replace(path, "^file:/*", "/")


def with_images(docs: DataFrame, image_folder: str) -> DataFrame:
    """Text rows, and others only if their image file exists below the folder."""
    there = docs.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(image_folder).select(_plain("path").alias("_there"))
    plain = docs.filter("type = 'text'")
    return plain.unionByName(docs.filter("type <> 'text'").join(there, _plain("img_path") == F.col("_there"), "left_semi").select(docs.columns))


def read_qa_folder(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files, each a list of objects or an object of objects, as (path, key, item VARIANT)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("path", F.col("_metadata.file_path"))
    raw = raw.withColumn("v", F.try_parse_json("value")).filter("v is not null")
    return spark.sql("select path, coalesce(x.key, cast(x.pos as string)) as key, x.value as item from {raw}, lateral variant_explode(v) as x", raw=raw)


def read_review_items(spark: SparkSession, path: str, task: str) -> DataFrame:
    """(item_id, pos, item): a list, {items: [...]}, one object, or JSONL; ids of eval items stay, others are task_pos.

    pos counts the items from 0 over all files of path, in order of their names; lines that do not parse are not counted.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # the parser stops after a first value, so a file of several lines of which the first is a value is JSONL
    some = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    many = (F.size(some) > 1) & F.try_parse_json(F.get(some, F.lit(0))).isNotNull()
    raw = raw.withColumn("v", F.when(~many, F.try_parse_json("value")))
    lists = raw.filter("v is not null").withColumn("kind", F.expr("schema_of_variant(v)"))
    one = lists.withColumn("v", F.expr("case when kind like 'ARRAY%' then v when try_variant_get(v, '$.items', 'variant') is not null then variant_get(v, '$.items', 'variant') else parse_json(concat('[', to_json(v), ']')) end"))
    items = spark.sql("select path, x.pos as pos, x.value as item from {one}, lateral variant_explode(v) as x", one=one)
    lines = raw.filter("v is null").select("path", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    items = items.unionByName(lines.filter(F.col("line").rlike(r"\}\s*$")).select("path", "pos", F.try_parse_json("line").alias("item")).filter("item is not null"))
    items = G.numbered(items, "path", "pos").select(F.col("_place").alias("pos"), "item")
    own = F.expr("try_variant_get(item, '$.id', 'string')")
    return items.select(F.when(own.startswith("eval_"), own).otherwise(F.concat(F.lit(task + "_"), F.col("pos").cast("string"))).alias("item_id"), "pos", "item")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_id, attributes), edges(src, tgt, attributes)) of a GraphML file; attributes are map<key, text>."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    read = lambda tag, cols: spark.read.format("xml").option("rowTag", tag).schema(cols).load(path)
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda x: F.struct(x["_key"], x["_VALUE"]))).alias("attributes")
    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("node_id"), attributes)
    edges = read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), attributes)
    return nodes, edges


TAXONOMY = "id string, name string, description string, cognitive_dimension string, parent_id string"


def tree_rows(trees: DataFrame) -> DataFrame:
    """trees(path, v VARIANT) -> (path, id, name, description, cognitive_dimension, parent_id), nested (children) or flat (parent_id).

    A level of children a step, each level rows of its own; nodes without id or name go.
    """
    get = lambda c: F.expr(f"try_variant_get(n, '$.{c}', 'string')")
    level = trees.select("path", F.explode(F.expr("try_variant_get(v, '$.nodes', 'array<variant>')")).alias("n"), F.lit(None).cast("string").alias("above"))
    out = None
    while out is None or not level.isEmpty():
        rows = level.select("path", get("id").alias("id"), get("name").alias("name"), get("description").alias("description"), get("cognitive_dimension").alias("cognitive_dimension"), F.coalesce("above", get("parent_id")).alias("parent_id"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select("path", get("id").alias("above"), F.explode(F.expr("try_variant_get(n, '$.children', 'array<variant>')")).alias("n"))
    return out.filter("id is not null and name is not null")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy files (JSON; a .yaml file where a YAML reader is installed) as (id, name, description, cognitive_dimension, parent_id).

    Files are parsed where they are read, and their trees become rows there; nothing passes the driver.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if path.endswith((".yaml", ".yml")):

        @F.udf("string")
        def as_json(x):
            import yaml

            return json.dumps(yaml.safe_load(x))

        text = text.withColumn("value", as_json("value"))
    return tree_rows(text.select("path", F.try_parse_json("value").alias("v"))).select("id", "name", "description", "cognitive_dimension", "parent_id")
