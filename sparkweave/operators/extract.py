"""Extraction: prompts per chunk, parsing responses into mentions, merging mentions into a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import graph as G
from ..functions import text as T

SEP, FIELD, RECORD, DONE = "<SEP>", "<|>", "##", "<|COMPLETE|>"

#: Our own wording; one row per language.
TEMPLATES = [
    ("en", "List the entities and relationships of the text as records.\nEntity types: {types}\nText:\n{text}\nRecords:"),
    ("zh", "以记录形式列出文本中的实体和关系。\n实体类型：{types}\n文本：\n{text}\n记录："),
]


def templates(spark, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(rows, "language string, template string")


def filled(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def extraction_prompts(chunks: DataFrame, entity_types: list[str]) -> DataFrame:
    """(chunk_id, prompt) by the chunk's language."""
    t = F.broadcast(templates(chunks.sparkSession))  # one row per language
    return chunks.join(t, "language").select("chunk_id", filled(F.col("template"), types=F.lit(", ".join(entity_types)), text=F.col("content")).alias("prompt"))


def merged_prompts(chunks: DataFrame, per_prompt: int, entity_types: list[str]) -> DataFrame:
    """chunks(chunk_id, full_doc_id, pos, content, language) -> (group_id, chunk_ids, prompt): k chunks of a document each."""
    rank = F.row_number().over(Window.partitionBy("full_doc_id").orderBy("pos", "chunk_id"))
    x = chunks.withColumn("g", F.floor((rank - 1) / per_prompt)).groupBy("full_doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "content", "language"))).alias("c"))
    body = F.array_join(F.transform("c", lambda r, i: F.concat(F.lit("[Text "), (i + 1).cast("string"), F.lit("]\n"), r["content"])), "\n\n")
    x = x.withColumns({"text": body, "language": F.try_element_at("c", F.lit(1))["language"], "chunk_ids": F.transform("c", lambda r: r["chunk_id"])})
    x = x.join(F.broadcast(templates(chunks.sparkSession)), "language")
    group = F.md5(F.array_join("chunk_ids", ","))
    return x.select(group.alias("group_id"), "chunk_ids", filled(F.col("template"), types=F.lit(", ".join(entity_types)), text=F.col("text")).alias("prompt"))


def split_response(groups: DataFrame) -> DataFrame:
    """groups(group_id, chunk_ids, response) -> (chunk_id, response): the section of each chunk.

    Without any marker every chunk gets the whole response, as does a chunk whose marker is missing.
    """
    mark = r"^\s*\[(?:Text|文本)\s*([0-9]+)\]\s*$"
    lines = groups.select("group_id", F.posexplode(F.split("response", "\n")).alias("pos", "line"))
    lines = lines.withColumn("m", F.when(F.col("line").rlike(mark), F.regexp_extract("line", mark, 1).cast("int")))
    part = F.last("m", ignorenulls=True).over(Window.partitionBy("group_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("part", part).filter("m is null and part is not null")
    sections = lines.groupBy("group_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("section"))
    chunks = groups.select("group_id", "response", F.posexplode("chunk_ids").alias("i", "chunk_id")).withColumn("part", F.col("i") + 1)
    return chunks.join(sections, ["group_id", "part"], "left").select("chunk_id", F.coalesce("section", "response").alias("response"))


def parse_records(responses: DataFrame, id_col: str = "chunk_id", text_col: str = "response") -> DataFrame:
    """(id_col, pos, fields): the records of each response, fields trimmed."""
    parts = F.filter(F.split(F.replace(F.col(text_col), F.lit(DONE), F.lit(RECORD)), RECORD, -1), lambda x: F.trim(x) != "")
    x = responses.select(F.col(id_col), F.posexplode(parts).alias("pos", "record"))
    inner = F.regexp_extract("record", r"(?s)\((.*)\)", 1)
    return x.withColumn("inner", inner).filter("inner <> ''").select(id_col, "pos", F.transform(F.split("inner", r"<\|>", -1), lambda x: F.trim(x)).alias("fields"))


def mentions(responses: DataFrame, id_col: str = "chunk_id", text_col: str = "response", bare_names: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities(entity_name, entity_type, description, source_id), relations(src_id, tgt_id, description, source_id)).

    Names are upper-cased and keep their quotes unless bare_names; records with under four fields or without a name go.
    """
    r = parse_records(responses, id_col, text_col).filter(F.size("fields") >= 4)
    kind = F.regexp_replace(F.lower(F.try_element_at("fields", F.lit(1))), "^[^a-z_]+|[^a-z_]+$", "")
    r = r.withColumn("kind", kind).filter("kind in ('entity', 'relationship')")
    f = lambda i: F.get("fields", F.lit(i - 1))
    name = (lambda c: F.regexp_replace(T.clean(c), "^\"|\"$", "")) if bare_names else T.clean
    second = T.clean(F.upper(f(3)))
    second = F.when(F.col("kind") == "entity", second).otherwise(F.regexp_replace(second, "^\"|\"$", "") if bare_names else second)
    # responses are made and parsed once for both tables
    r = G.settled(r.select("kind", name(F.upper(f(2))).alias("first"), second.alias("second"), T.clean(f(4)).alias("description"), F.col(id_col).alias("source_id")))
    entities = r.filter("kind = 'entity'").select(F.col("first").alias("entity_name"), F.col("second").alias("entity_type"), "description", "source_id")
    relations = r.filter("kind = 'relationship'").select(F.col("first").alias("src_id"), F.col("second").alias("tgt_id"), "description", "source_id")
    return entities.filter(F.trim("entity_name") != ""), relations.filter("trim(src_id) <> '' and trim(tgt_id) <> '' and src_id <> tgt_id")


def merge_nodes(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Mentions and stored nodes(node_id, entity_type, descriptions, source_ids) -> nodes, one per name.

    The type is the commonest one, a stored node counting once, ties by the smaller name;
    descriptions and sources are sorted and distinct.  Types are counted before names are grouped.
    """
    x = new.select(F.col("entity_name").alias("node_id"), "entity_type", "description", "source_id")
    x = x.select("node_id", "entity_type", F.col("description").alias("d"), F.col("source_id").cast("string").alias("s"), F.lit(1).alias("vote"))
    if stored is not None:
        null = F.lit(None).cast("string")
        row = lambda d, s, vote: stored.select("node_id", "entity_type", d.alias("d"), s.alias("s"), F.lit(vote).alias("vote"))
        x = x.unionByName(row(null, null, 1)).unionByName(row(F.explode("descriptions"), null, 0)).unionByName(row(null, F.explode("source_ids"), 0))
    kinds = x.groupBy("node_id", "entity_type").agg(F.sum("vote").alias("n"), F.collect_set("d").alias("d"), F.collect_set("s").alias("s"))
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return kinds.groupBy("node_id").agg(F.min_by("entity_type", F.struct(-F.col("n"), F.col("entity_type"))).alias("entity_type"), both("d").alias("descriptions"), both("s").alias("source_ids"))


def _collected(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.groupBy(*keys).agg(F.array_sort(F.collect_set("d")).alias("descriptions"), F.array_sort(F.collect_set("s")).alias("source_ids"))


def merge_edges(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Mentions and stored edges -> edges(src, tgt, descriptions, source_ids), one per unordered pair, src < tgt."""
    x = new.select(F.least("src_id", "tgt_id").alias("src"), F.greatest("src_id", "tgt_id").alias("tgt"), F.col("description").alias("d"), F.col("source_id").cast("string").alias("s"))
    if stored is not None:
        null = F.lit(None).cast("string")
        x = x.unionByName(stored.select("src", "tgt", F.explode("descriptions").alias("d"), null.alias("s"))).unionByName(stored.select("src", "tgt", null.alias("d"), F.explode("source_ids").alias("s")))
    return _collected(x, ["src", "tgt"])


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and an UNKNOWN node, with the texts of its edges, for each end of an edge that has none."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node_id"), "descriptions", "source_ids").join(nodes.select("node_id"), "node_id", "left_anti")
    new = ends.groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("descriptions")))).alias("descriptions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"))
    return nodes.select("node_id", "entity_type", "descriptions", "source_ids").unionByName(new.select("node_id", F.lit("UNKNOWN").alias("entity_type"), "descriptions", "source_ids"))


def joined(table: DataFrame) -> DataFrame:
    """Arrays of texts as <SEP>-joined strings, for files of that layout."""
    return table.withColumns({"description": F.array_join("descriptions", SEP), "source_id": F.array_join("source_ids", SEP)}).drop("descriptions", "source_ids")


def pending(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks to extract, cached (chunk_id, response)): the cache is keyed by the md5 of content."""
    x = chunks.withColumn("content_hash", F.md5("content"))
    todo = x.join(cache.select("content_hash"), "content_hash", "left_anti")
    return todo, x.join(cache.select("content_hash", "response"), "content_hash").select("chunk_id", "response")


def summary_routes(table: DataFrame, text_col: str = "description", limit: int = 200) -> DataFrame:
    """Adds tokens, route ('keep' below the limit, else 'summarize') and the text to summarize, cut to the limit in characters of tokens."""
    tokens = T.token_estimate(text_col)
    x = table.withColumn("tokens", tokens)
    cut = F.substring(text_col, 1, limit * 4)
    return x.withColumns({"route": F.when(F.col("tokens") < limit, "keep").otherwise("summarize"), "prompt_text": F.when(F.col("tokens") >= limit, cut)})


def with_summaries(table: DataFrame, responses: DataFrame, key: str, text_col: str = "description") -> DataFrame:
    return table.join(responses.select(key, F.col("response").alias("_s")), key, "left").withColumn(text_col, F.coalesce("_s", text_col)).drop("_s")


def image_prompts(docs: DataFrame, entity_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(prompts from image captions, quarantined rows of other types)."""
    images = docs.filter("type = 'image' and size(image_caption) > 0").withColumn("content", F.array_join("image_caption", "\n"))
    images = images.withColumn("language", T.main_language("content")).withColumnRenamed("doc_id", "chunk_id")
    return extraction_prompts(images, entity_types), docs.filter("type in ('table', 'equation')")


def coreference_prompts(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, full_doc_id, pos, content) -> (chunk_id, prompt): each chunk beside its document's first."""
    first = F.first("content").over(Window.partitionBy("full_doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return chunks.select("chunk_id", F.concat(F.lit("Reference:\n"), first, F.lit("\nRewrite with every pronoun replaced by its referent:\n"), F.col("content")).alias("prompt"))


def enriched(nodes: DataFrame, results: DataFrame, known: DataFrame, sources=("wikipedia", "google", "bing")) -> DataFrame:
    """results(entity, source, description) of outside searches for nodes that are not known yet, one column per source."""
    x = results.filter("trim(coalesce(description, '')) <> ''").join(known.select(F.col("node_id").alias("entity")), "entity", "left_anti")
    x = x.join(nodes.select(F.col("node_id").alias("entity")), "entity", "left_semi")
    return x.groupBy("entity").pivot("source", list(sources)).agg(F.min("description"))


def rule_extraction(chunks: DataFrame) -> DataFrame:
    """A model-free backend: capitalised words are entities and neighbours are related; (chunk_id, response)."""
    words = F.transform(F.regexp_extract_all("content", F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0)), lambda w: F.upper(w))
    x = chunks.select("chunk_id", words.alias("w"))
    entity = F.transform(F.array_distinct("w"), lambda w: F.concat(F.lit('("entity"<|>"'), w, F.lit('"<|>"TERM"<|>"'), w, F.lit(' occurs")')))
    near = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(F.lit('("relationship"<|>"'), a, F.lit('"<|>"'), b, F.lit('"<|>"next to")')))
    return x.select("chunk_id", F.concat(F.array_join(F.concat(entity, F.array_distinct(near)), RECORD), F.lit(RECORD + DONE)).alias("response"))
