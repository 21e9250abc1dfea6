"""Parsing responses into question-answer pairs and items, provenance, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

_Q = r"(?:Question|问题)"
_A = r"(?:Answer|答案|回答)"


#: What may come before the labels, and what makes a line a question: fixed values.
_PREAMBLE = r"(?i)^(?:(?:Here is|This is|Below is)[^\n]*?multi-hop[^\n]*?[：:]\s*|(?:以下是|这是)[^\n]*?多跳[^\n]*?[：:]\s*|根据[^\n]*?(?:以下是|如下)[：:]\s*|Based on[^\n]*?(?:here is|as follows)[：:]\s*|(?:好的|好|OK)[，,。.]\s*)"
_ASKS = "[?？]|what|who|how|why|when|where|什么|谁|如何|为什么|何时|哪里"


def _let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _after(text: Column, label: str, until: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?is){label}\s*[:：]\s*(.*?)\s*(?={until}|\z)", 1))


def atomic_pairs(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """(id, pos, question, answer): every pair of a response, whatever marks and rules separate them."""
    text = F.regexp_replace(T.repaired_qa("response"), r"(?m)^\s*(?:\*\*\s*\*\*|\*\*|-{3,})\s*$", "\n")
    parts = F.filter(F.split(text, r"(?m)^(?=Question: )"), lambda p: p.startswith("Question: "))
    x = responses.select(F.col(id_col), F.posexplode(parts).alias("pos", "part"))
    x = x.select(id_col, "pos", _after(F.col("part"), "Question", "Answer:").alias("question"), _after(F.col("part"), "Answer", "Question:").alias("answer"))
    return x.filter("question <> '' and answer <> ''")


def only_questions(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """(id, question): the first labelled question, else the first line with a question mark, else the first line."""
    text = T.repaired_qa("response")
    labelled = F.regexp_extract(text, r"(?m)^Question: *(.+)$", 1)
    asked = F.regexp_extract(text, r"(?m)^\s*(.+[?？])\s*$", 1)
    first = F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1)
    q = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (labelled, asked, first)])
    return responses.select(F.col(id_col), q.alias("question")).filter("question is not null")


def only_answers(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """(id, answer): after a label, else after a question line, else the last paragraph, else all of it."""
    t = T.without_thoughts("response")
    labelled = _after(t, _A, r"\n\s*" + _Q)
    after = F.regexp_extract(t, r"(?s)^[^\n]*[?？]\s*\n+(.+)$", 1)
    last = F.try_element_at(F.filter(F.split(t, r"\n\s*\n"), lambda p: F.trim(p) != ""), F.lit(-1))
    a = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (labelled, after, last, t)])
    return responses.select(F.col(id_col), a.alias("answer")).filter("answer is not null")


def aggregated_parts(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """(id, rephrased, question): the rephrased text (labelled, or all before the question) and the question."""
    t = F.col("response")
    label = r"(?:Rephrased Text|重述文本|改写文本)"
    rephrased = _after(t, label, r"\n\s*" + _Q)
    before = F.trim(F.regexp_extract(t, rf"(?is)^(.*?)(?=\n\s*{_Q}\s*[:：]|\z)", 1))
    return responses.select(F.col(id_col), F.when(rephrased != "", rephrased).otherwise(before).alias("rephrased"), _after(t, _Q, r"\n\s*" + _A).alias("question"))


def multi_hop(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """(id, question, answer, reasoning_path): by labels, or leniently where one is missing.

    An answer whose first line asks (a question mark or a question word) gives that line as the
    question.  Else, of a response without a question, the first sentence of over five characters is
    the question and the rest the answer.  Rows that still lack either go.
    """
    path = r"(?:Reasoning Path|Reasoning|Path|推理路径|推理|路径)"
    rest = rf"\n\s*(?:{_Q}|{_A}|{path})\s*[:：]"
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^\"+|\"+$", ""), "^'+|'+$", "")

    def labelled(t: Column) -> Column:
        return F.struct(t.alias("t"), bare(_after(t, _Q, rest)).alias("q"), bare(_after(t, _A, rest)).alias("a"), bare(_after(t, path, rest)).alias("p"))

    def from_answer(x: Column) -> Column:
        line, more = F.trim(F.regexp_extract(x["a"], r"^([^\n]*)", 1)), _stripped(F.regexp_extract(x["a"], r"(?s)^[^\n]*\n(.*)$", 1))
        asks = (x["q"] == "") & (x["a"] != "") & F.lower(line).rlike(_ASKS)
        return F.struct(x["t"].alias("t"), F.when(asks, line).otherwise(x["q"]).alias("q"), F.when(asks & x["a"].contains("\n"), more).otherwise(x["a"]).alias("a"), x["p"].alias("p"))

    def from_first(x: Column) -> Column:
        first, more = F.trim(F.regexp_extract(x["t"], r"^([^。！？\n]*)", 1)), _stripped(F.regexp_extract(x["t"], r"(?s)^[^。！？\n]*(.*)$", 1))
        lone = (x["q"] == "") & (F.length(first) > 5)
        return F.struct(F.when(lone, first).otherwise(x["q"]).alias("q"), F.when(lone, more).otherwise(x["a"]).alias("a"), x["p"].alias("reasoning_path"))

    x = responses.select(F.col(id_col), _let(_let(_let(_stripped(F.regexp_replace(T.repaired("response"), _PREAMBLE, "")), labelled), from_answer), from_first).alias("x")).select(id_col, F.col("x.q").alias("q"), F.col("x.a").alias("a"), "x.reasoning_path")
    return x.select(id_col, F.col("q").alias("question"), F.col("a").alias("answer"), "reasoning_path").filter("question <> '' and answer <> ''")


def chain_of_thought(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """(id, question, reasoning_path, thinking_process, final_answer).

    Without a label the final answer is the last paragraph, or the last sentence of a single paragraph.
    """
    path, final = r"(?:Reasoning-Path Design|Reasoning Path|推理路径设计|推理路径)", r"(?:Final Answer|最终答案)"
    think = r"(?:Thinking Process|Thinking|思考过程)"
    t = F.col("response")
    rest = rf"\n\s*(?:{_Q}|{path}|{think}|{final})\s*[:：]"
    x = responses.select(F.col(id_col), "response", _after(t, _Q, rest).alias("question"), _after(t, path, rest).alias("reasoning_path"), _after(t, think, rest).alias("thinking"), _after(t, final, rest).alias("final"))
    paragraphs = F.filter(F.split("response", r"\n\s*\n"), lambda p: F.trim(p) != "")
    x = x.withColumn("p", paragraphs).withColumn("s", F.filter(F.split("response", r"(?<=[.。!！?？])\s+"), lambda p: F.trim(p) != ""))
    tail = F.when(F.size("p") > 1, F.try_element_at("p", F.lit(-1))).otherwise(F.try_element_at("s", F.lit(-1)))
    head = F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "\n\n")).otherwise(F.array_join(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), " "))
    return x.select(
        id_col, "question", "reasoning_path", F.when(F.col("thinking") != "", F.col("thinking")).otherwise(F.trim(head)).alias("thinking_process"),
        F.when(F.col("final") != "", F.col("final")).otherwise(F.trim(tail)).alias("final_answer"),
    )


def hierarchical(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    reason = r"(?:Hierarchical Reasoning|层级推理)"
    t = F.col("response")
    rest = rf"\n\s*(?:{_Q}|{_A}|{reason})\s*[:：]"
    why = _after(t, reason, rest)
    return responses.select(F.col(id_col), _after(t, _Q, rest).alias("question"), _after(t, _A, rest).alias("answer"), F.when(why != "", why).alias("hierarchical_reasoning")).filter("question <> '' and answer <> ''")


def intent_pairs(responses: DataFrame, id_col: str = "batch_id") -> DataFrame:
    """Labelled; else question and answer are parted by a blank line; else by the first line's end."""
    t = F.trim("response")
    q, a = _after(t, _Q, r"\n\s*" + _A), _after(t, _A, r"\n\s*" + _Q)
    labelled = (q != "") & (a != "")
    blank, line = F.split(t, r"\n\s*\n", 2), F.split(t, "\n", 2)
    two = F.when(F.size(blank) == 2, blank).when(F.size(line) == 2, line)
    return responses.select(F.col(id_col), F.when(labelled, q).otherwise(F.trim(two[0])).alias("question"), F.when(labelled, a).otherwise(F.trim(two[1])).alias("answer")).filter("question is not null and answer is not null")


def eval_items(responses: DataFrame) -> DataFrame:
    """responses(type, difficulty, batch_id, response) -> items with status.

    JSON objects or lists of them; rows without question or answer go; a response that does not parse
    gives one placeholder row with status 'unparsed'.
    """
    x = responses.withColumn("v", T.parsed_json("response"))
    shape = F.expr("schema_of_variant(v)")
    many = F.expr("try_variant_get(v, '$', 'array<variant>')")
    x = x.withColumn("items", F.when(F.col("v").isNull(), None).when(shape.startswith("ARRAY"), many).otherwise(F.array("v")))
    x = x.select("type", "difficulty", "batch_id", "response", F.posexplode_outer("items").alias("pos", "item"))
    get = lambda path, kind="string": F.expr(f"try_variant_get(item, '{path}', '{kind}')")
    x = x.select(
        "type", "difficulty", "batch_id", "pos", F.when(F.col("item").isNull(), F.substring("response", 1, 200)).otherwise(get("$.question")).alias("question"),
        F.coalesce(get("$.reference_answer"), get("$.answer")).alias("reference_answer"), F.coalesce(get("$.distractors", "array<string>"), F.array().cast("array<string>")).alias("distractors"),
        F.expr("try_variant_get(item, '$.evaluation_criteria', 'map<string,string>')").alias("evaluation_criteria"), F.when(F.col("item").isNull(), "unparsed").otherwise("ok").alias("status"),
    )
    return x.filter("status = 'unparsed' or (trim(coalesce(question, '')) <> '' and trim(coalesce(reference_answer, '')) <> '')").withColumn("id", eval_id("type", "question"))


def critic_verdicts(responses: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(id, passed, score 0..1, reason, suggestions): what cannot be read passes with 0.5 and says so."""
    x = responses.withColumn("v", T.parsed_json("response"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    score = F.coalesce(get("$.overall_score", "double"), get("$.score", "double"))
    return x.select(
        F.col(id_col), F.coalesce(get("$.passed", "boolean"), F.lit(True)).alias("passed"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.5)))).alias("score"),
        F.coalesce(get("$.reason", "string"), F.when(F.col("v").isNull(), "unparsed")).alias("reason"), F.coalesce(get("$.suggestions", "array<string>"), F.array().cast("array<string>")).alias("suggestions"),
    )


def reviewer_scores(responses: DataFrame, parts=("accuracy", "completeness", "clarity", "relevance", "usefulness"), id_col: str = "item_id") -> DataFrame:
    x = responses.withColumn("v", T.parsed_json("response"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    return x.select(F.col(id_col), get("$.overall_score", "double").alias("overall_score"), *[get(f"$.{p}", "double").alias(p) for p in parts], get("$.reason", "string").alias("reason"))


def taxonomy_nodes(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses(doc_id, response) -> (tree rows per doc_id, unreadable responses to retry)."""
    x = responses.withColumn("v", T.parsed_json("response"))
    bad = x.filter("v is null").select("doc_id", "response")
    level = x.filter("v is not null").select("doc_id", F.explode(F.coalesce(F.expr("try_variant_get(v, '$.nodes', 'array<variant>')"), F.array("v"))).alias("n"), F.lit(None).cast("string").alias("parent_id"))
    out = None
    while out is None or not level.isEmpty():
        get = lambda c: F.expr(f"try_variant_get(n, '$.{c}', 'string')")
        rows = level.select("doc_id", get("id").alias("id"), get("name").alias("name"), get("description").alias("description"), get("cognitive_dimension").alias("cognitive_dimension"), F.coalesce("parent_id", get("parent_id")).alias("parent_id"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select("doc_id", get("id").alias("parent_id"), F.explode(F.expr("try_variant_get(n, '$.children', 'array<variant>')")).alias("n"))
    return out.filter("id is not null and name is not null"), bad


# Assembly


def provenance(qa: DataFrame, batches: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """qa(qa_id, batch_id, ...) with source_chunks and source_documents (200-character previews).

    batches(batch_id, source_ids array<string>): the chunks behind a batch's units.
    """
    ids = qa.select("qa_id", "batch_id").join(batches.select("batch_id", F.explode(F.array_distinct("source_ids")).alias("chunk_id")), "batch_id")
    c = ids.join(chunks.select("chunk_id", "full_doc_id", F.col("content").alias("chunk")), "chunk_id").join(docs.select(F.col("doc_id").alias("full_doc_id"), F.substring("content", 1, 200).alias("preview")), "full_doc_id", "left")
    c = c.groupBy("qa_id").agg(F.array_sort(F.collect_set(F.struct("chunk_id", "chunk"))).alias("source_chunks"), F.array_sort(F.collect_set(F.struct(F.col("full_doc_id").alias("doc_id"), "preview"))).alias("source_documents"))
    return qa.join(c, "qa_id", "left")


def with_context(qa: DataFrame, batches: DataFrame, mode: str | None = None) -> DataFrame:
    """qa(qa_id, batch_id, ...) with context, graph and metadata of its batch.

    batches(batch_id, nodes array<struct<node_id, description, ...>>, edges array<struct<src, tgt, description, ...>>);
    a batch holds a few units (see partitions), so a row does too.  Fields that units lack are ''.
    metadata.has_chunks and has_documents tell what provenance() found, if it came before; mode: the
    generation mode, else the column of that name.
    """
    fields = lambda c: batches.schema[c].dataType.elementType.names
    get = lambda x, have, c: F.coalesce(x[c].cast("string"), F.lit("")) if c in have else F.lit("")
    n, e = fields("nodes"), fields("edges")
    nodes = F.transform("nodes", lambda x: F.struct(get(x, n, "node_id").alias("name"), get(x, n, "description").alias("description"), get(x, n, "chunk_id").alias("chunk_id"), get(x, n, "entity_type").alias("entity_type")))
    edges = F.transform("edges", lambda x: F.struct(get(x, e, "src").alias("source"), get(x, e, "tgt").alias("target"), get(x, e, "description").alias("description"), get(x, e, "relation_type").alias("relation_type")))
    b = batches.select(
        "batch_id", F.struct(nodes.alias("nodes"), edges.alias("edges")).alias("context"),
        F.struct(
            F.transform("nodes", lambda x: x["node_id"]).alias("entities"), F.transform("edges", lambda x: F.array(x["src"], x["tgt"])).alias("relationships"),
            F.size("nodes").alias("entity_count"), F.size("edges").alias("relationship_count"),
        ).alias("graph"),
    )
    x = qa.join(b, "batch_id", "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) if c in qa.columns else F.lit(False)
    kind = F.lit(mode) if mode is not None else F.col("mode") if "mode" in qa.columns else F.lit(None).cast("string")
    return x.withColumn("metadata", F.struct(kind.alias("generation_mode"), (F.col("graph.entity_count") + F.col("graph.relationship_count")).alias("batch_size"), some("source_chunks").alias("has_chunks"), some("source_documents").alias("has_documents")))


def question_of(df: DataFrame) -> Column:
    """The question of a row in any layout: instruction, first human or user turn, or question."""
    options = []
    if "instruction" in df.columns:
        options.append(F.col("instruction"))
    if "conversations" in df.columns:
        options.append(F.get(F.filter("conversations", lambda x: x["from"] == "human"), F.lit(0))["value"])
    if "messages" in df.columns:
        options.append(F.get(F.filter("messages", lambda x: x["role"] == "user"), F.lit(0))["content"])
    if "question" in df.columns:
        options.append(F.col("question"))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def without_repeats(items: DataFrame, order: str, stored: DataFrame | None = None) -> DataFrame:
    """First item by order of each md5(mode::question), none that stored(qa_hash) holds; rows without a question stay."""
    q = question_of(items)
    x = items.withColumn("qa_hash", F.when(F.trim(F.coalesce(q, F.lit(""))) != "", F.md5(F.concat_ws("::", F.col("mode"), F.trim(q)))))
    free = x.filter("qa_hash is null")
    keyed = x.filter("qa_hash is not null").withColumn("_n", F.row_number().over(Window.partitionBy("qa_hash").orderBy(order))).filter("_n = 1").drop("_n")
    if stored is not None:
        keyed = keyed.join(stored.select("qa_hash"), "qa_hash", "left_anti").select(x.columns)
    return keyed.unionByName(free)


def with_mode(items: DataFrame, mode: str) -> DataFrame:
    return items.withColumn("mode", F.lit(mode))


def mode_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("mode").agg(F.count("*").alias("n"))


def eval_id(kind, question) -> Column:
    k = F.col(kind)
    return F.concat(F.lit("eval_"), F.substring(k, 1, 4), F.lit("_"), F.substring(F.md5(F.concat(k, F.lit(":"), F.col(question))), 1, 12))


def reasoning_hops(edges="edges") -> Column:
    return F.least(F.size(edges), F.lit(5))
