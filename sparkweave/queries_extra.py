"""Queries over readers, exports, model responses, assessment, sampling and generation flows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import graph as G
from .functions import text as T
from .operators import assess, complete, evaluation as E, extract, generate, parse, partition as P, taxonomy as X
from .queries import _GRAPH, part_graph, query, t
from .queries_more import _TREE, part_tree
from .sources import exports, readers


def scratch(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    G.ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/files-{uuid.uuid4().hex}"


# Readers and writers: tables written as files and read back


@query("select item_id::varchar as type, text as content from benchmark")
def read_json_lines(spark, d):
    folder = scratch(spark)
    t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("type"), F.col("text").alias("content")).write.json(folder)
    good, bad = readers.read_jsonl(spark, folder)
    return good.unionByName(bad.select(F.lit("bad").alias("type"), F.col("value").alias("content"), "path")).select("type", "content")


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def read_json_lists(spark, d):
    """A file for each region that holds a list of its nations."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "r_name"))).alias("value"))
    folder = scratch(spark)
    lists.repartition("n_regionkey").write.partitionBy("n_regionkey").text(folder)
    return readers.read_json(spark, folder).select("n_nationkey", "n_name", "r_name")


@query("select p_partkey::varchar as p_partkey, p_name, p_type from part")
def read_csv_files(spark, d):
    folder = scratch(spark)
    exports.write_csv(t(spark, d, "part").select("p_partkey", "p_name", "p_type"), folder)
    return readers.read_csv(spark, folder).select("p_partkey", "p_name", "p_type")


@query("select n_name || chr(10) || n_nationkey || chr(10) as content, 'text' as type from nation union all select n_name || chr(10) || n_nationkey || chr(10), 'text' from nation union all select n_name || chr(10) || n_nationkey || chr(10), 'text' from nation")
def read_text_files(spark, d):
    """A file for each nation, read as text, as Markdown and as a folder."""
    folder = scratch(spark)
    n = t(spark, d, "nation").select("n_nationkey", F.concat_ws("\n", "n_name", F.col("n_nationkey").cast("string")).alias("value"))
    n.repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    x = readers.read_text(spark, folder).unionByName(readers.read_markdown(spark, folder + "/n_nationkey=*")).unionByName(readers.read_folder(spark, folder, "txt", recursive=True))
    return x.select("content", "type")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'quarantined' else 'kept' end as place from supplier where s_suppkey % 5 <> 0 or s_suppkey % 3 = 0")
def checked_documents(spark, d):
    """Text rows without text are quarantined, blank ones dropped."""
    key = F.col("s_suppkey")
    docs = t(spark, d, "supplier").select(key, F.lit("text").alias("type"), F.when(key % 3 == 0, None).when(key % 5 == 0, "  ").otherwise(F.col("s_name")).alias("content"))
    good, bad = readers.checked(docs)
    return readers.without_blank(good).select("s_suppkey", F.lit("kept").alias("place")).unionByName(bad.select("s_suppkey", F.lit("quarantined").alias("place")))


@query("select r_name as content, 'text' as type from region union all select r_name, 'image' from region where r_regionkey % 2 = 0")
def parser_output_images(spark, d):
    """A parser's list of texts and images; images whose file is missing go."""
    folder = scratch(spark)
    r = t(spark, d, "region")
    r.filter("r_regionkey % 2 = 0").select("r_regionkey", F.col("r_name").alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(folder + "/lists/images")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder + "/lists/images").select(F.regexp_extract("path", "(images/r_regionkey=([0-9]+)/[^/]+)$", 1).alias("img_path"), F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("long").alias("r_regionkey"))
    images = r.join(files, "r_regionkey", "left").select(F.lit("image").alias("type"), F.coalesce("img_path", F.lit("images/none.png")).alias("img_path"), F.col("r_name").alias("text"))
    rows = r.select(F.lit("text").alias("type"), F.lit("").alias("img_path"), F.col("r_name").alias("text")).unionByName(images)
    rows.groupBy().agg(F.to_json(F.collect_list(F.struct("type", "img_path", "text"))).alias("value")).write.text(folder + "/made")
    spark.read.text(folder + "/made").coalesce(1).write.mode("append").text(folder + "/lists")
    docs = readers.read_parser_output(spark, folder + "/lists/part-*")
    return readers.with_images(docs, folder + "/lists/images").select("content", "type")


@query(f"with {_GRAPH} select src, tgt, 'edge' as kind from e union all select node_id, null, degree::varchar from g")
def graphml_round_trip(spark, d):
    folder = scratch(spark)
    e = part_graph(spark, d)
    note = lambda c: F.create_map(F.lit("note"), c)
    exports.write_graphml(G.degrees(e).select("node_id", note(F.col("degree").cast("string")).alias("attributes")), e.select("src", "tgt", note(F.lit("edge")).alias("attributes")), folder)
    nodes = readers.read_graphml(spark, folder + "/nodes")[0]
    edges = readers.read_graphml(spark, folder + "/edges")[1]
    return edges.select("src", "tgt", F.col("attributes")["note"].alias("kind")).unionByName(nodes.select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("tgt"), F.col("attributes")["note"].alias("kind")))


@query("select l_returnflag as input_file, count(*) as rows, round(avg(l_quantity), 4) as avg_q, min(l_quantity)::double as min_q, max(l_quantity)::double as max_q from lineitem group by 1")
def file_metrics(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("input_file"), F.col("l_quantity").cast("double").alias("q"))
    return exports.file_metrics(x).withColumn("avg_q", F.round("avg_q", 4))


# Text functions


@query(r"select item_id, list_filter(list_transform(string_split_regex(text, '\. |, '), lambda x: trim(x)), lambda x: x <> '') as parts from benchmark")
def marker_split(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.split_by_markers("text", [". ", ", "]).alias("parts"))


@query(r"select value, count(*) as n, regexp_full_match(value, '[-+]?[0-9]*\.?[0-9]+') as is_number from (select p_name as value from part union all select p_size::varchar from part union all select '-' || p_size || '.5' from part union all select p_size || '.' from part) group by value")
def number_strings(spark, d):
    p, size = t(spark, d, "part"), F.col("p_size").cast("string")
    x = p.select(F.explode(F.array("p_name", size, F.concat(F.lit("-"), size, F.lit(".5")), F.concat(size, F.lit(".")))).alias("value"))
    return x.groupBy("value").agg(F.count("*").alias("n")).withColumn("is_number", T.is_number("value"))


@query("select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, case when row_number() over (partition by conv_id order by turn) % 2 = 1 then 'user' else 'assistant' end as role, text as content from conversations")
def chat_messages(spark, d):
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return x.select("conv_id", F.posexplode(T.as_conversation("turns")).alias("pos", "m")).select("conv_id", "pos", "m.*")


@query("select s_suppkey, unnest([s_name, s_nationkey::varchar]) as part from supplier")
def joined_ids(spark, d):
    s = t(spark, d, "supplier")
    return s.select("s_suppkey", F.explode(T.id_list(F.concat(F.lit(" "), "s_name", F.lit(" <SEP><SEP> "), F.col("s_nationkey").cast("string")))).alias("part"))


@query("select item_id, case when item_id % 2 = 0 then '<think>' || md5(text) || '</think>' else md5(text) end as thoughts, md5(text) as chatter, md5(text) as fences from benchmark")
def bare_responses(spark, d):
    """Responses without a model's thoughts, chatter and fences; thoughts alone stay."""
    b = t(spark, d, "benchmark")
    h, think = F.md5("text"), F.concat(F.lit("<think>"), F.md5("text"), F.lit("</think>"))
    return b.select(
        "item_id", T.without_thoughts(F.when(F.col("item_id") % 2 == 0, think).otherwise(F.concat(think, F.lit("\n "), h))).alias("thoughts"),
        T.without_chatter(F.concat(F.lit("Sure, here is the answer:\n"), h, F.lit("\n\nLet me know if more is needed."))).alias("chatter"),
        T.without_fences(F.concat(F.lit("```text\n"), h, F.lit("\n```"))).alias("fences"),
    )


@query("select item_id, md5(text) as a, null as b, true as c from benchmark")
def mended_json(spark, d):
    body = F.concat(F.lit("Here it is:\n```json\n{“a”: “"), F.md5("text"), F.lit("”, \"b\": None, \"c\": True,}\n```"))
    v = t(spark, d, "benchmark").select("item_id", T.parsed_json(body).alias("v"))
    get = lambda c, kind: F.expr(f"try_variant_get(v, '$.{c}', '{kind}')").alias(c)
    return v.select("item_id", get("a", "string"), get("b", "string"), get("c", "boolean"))


@query("select item_id, length(text) as characters, greatest(1, ceil(length(text) / 100.0))::int as windows, ((length(text) - 1) % 100 + 1)::int as last from benchmark where text <> ''")
def tokenizer_windows(spark, d):
    """Windows by a tokenizer that is plugged in: here code points are the tokens."""
    encode = lambda x: [ord(c) for c in x]
    x = t(spark, d, "benchmark").filter("text <> ''").select("item_id", T.token_counter(encode)("text").alias("characters"), T.token_ids(encode)("text").alias("ids"))
    x = x.withColumn("w", T.token_windows("ids", 100, 0))
    return x.select("item_id", "characters", F.size("w").alias("windows"), F.size(F.element_at("w", -1)).alias("last"))


# Extraction


_LANG = "case when len(regexp_extract_all(text, '[一-鿿]')) > 0 and len(regexp_extract_all(text, '[一-鿿]')) >= len(regexp_extract_all(text, '[A-Za-z]')) then 'zh' else 'en' end"
_PROMPT = {k: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{types}", "person, place").replace("{text}", "' || {0} || '") + "'" for k, v in extract.TEMPLATES}


def _prompt_sql(body: str, lang: str) -> str:
    return f"case when {lang} = 'zh' then {_PROMPT['zh'].replace('{0}', body)} else {_PROMPT['en'].replace('{0}', body)} end"


@query(f"select item_id as chunk_id, {_prompt_sql('text', _LANG)} as prompt from benchmark")
def extraction_prompts(spark, d):
    c = t(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content"), T.main_language("text").alias("language"))
    return extract.extraction_prompts(c, ["person", "place"])


@query(f"""with c as (select *, (row_number() over (partition by conv_id order by turn) - 1) // 2 as g, (row_number() over (partition by conv_id order by turn) - 1) % 2 + 1 as i from conversations),
m as (select conv_id, g, string_agg('[Text ' || i || ']' || chr(10) || text, chr(10) || chr(10) order by turn) as body, string_agg(conv_id || ':' || turn, ',' order by turn) as ids, arg_min(text, turn) as text from c group by conv_id, g)
select md5(ids) as group_id, ids, {_prompt_sql('body', _LANG)} as prompt from m""")
def merged_prompts(spark, d):
    c = t(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("full_doc_id"), F.col("turn").alias("pos"), F.col("text").alias("content"), T.main_language("text").alias("language"))
    return extract.merged_prompts(c, 2, ["person", "place"]).select("group_id", F.array_join("chunk_ids", ",").alias("ids"), "prompt")


@query(f"with p as (select page_id, url || chr(10) || page_id as text from pages where page_id % 3 = 0) select page_id as chunk_id, {_prompt_sql('text', _LANG)} as prompt from p union all select page_id, 'quarantined' from pages where page_id % 3 = 1")
def image_prompts(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 3 == 0, "image").when(F.col("page_id") % 3 == 1, "table").otherwise("image").alias("type"),
        F.when(F.col("page_id") % 3 == 0, F.array("url", F.col("page_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("image_caption"))
    prompts, aside = extract.image_prompts(p, ["person", "place"])
    return prompts.unionByName(aside.select(F.col("doc_id").alias("chunk_id"), F.lit("quarantined").alias("prompt")))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'short ' || s_name else s_name end as description from supplier")
def summaries_applied(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("description"))
    r = s.filter("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("short "), "description").alias("response"))
    return extract.with_summaries(s, r, "s_suppkey").select("s_suppkey", "description")


# Graph access


@query(f"with {_GRAPH}, p as (select distinct 'S' || l_suppkey as src, 'P' || (l_partkey + l_orderkey % 2) as tgt from lineitem) select p.src, p.tgt, e.src is not null as there from p left join e on e.src = p.tgt and e.tgt = p.src")
def edge_lookup(spark, d):
    """Pairs in the other orientation, some of which are no edges."""
    pairs = t(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), F.col("l_partkey") + F.col("l_orderkey") % 2).alias("tgt")).distinct()
    return G.find_edges(part_graph(spark, d).withColumn("mark", F.lit(1)), pairs).select("src", "tgt", F.col("mark").isNotNull().alias("there"))


@query(f"with {_GRAPH} select u as node_id, v as neighbour from b where u in (select 'S' || s_suppkey from supplier where s_acctbal < 0)")
def node_neighbours(spark, d):
    return G.node_edges(part_graph(spark, d), t(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("S"), "s_suppkey").alias("node_id")))


@query("select 'N' || n_nationkey as community_id, 'N' || n_nationkey as unit_id, 'node' as kind from nation union all select 'all', 'R' || r_regionkey, 'node' from region")
def fallback_batches(spark, d):
    """No communities: one of all nodes where their tokens fit, else one for each node."""
    none = spark.createDataFrame([], "community_id string, unit_id string, kind string, ord int")
    n = t(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node_id"))
    r = t(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node_id"))
    return P.or_fallback(none, n, max_tokens=2000).unionByName(P.or_fallback(none, r, max_tokens=2000)).select("community_id", "unit_id", "kind")


# Assessment


@query("with d as (select distinct text as description from benchmark where trim(text) <> '') select description, description as statement, 'yes' as gt from d union select description, md5(description), 'no' from d union select description, description, 'yes' from d")
def statement_set(spark, d):
    x = t(spark, d, "benchmark").select(F.col("text").alias("description"))
    x = assess.descriptions(x, x)
    answers = x.select("description", F.md5("description").alias("response"), F.lit("no").alias("gt")).unionByName(x.select("description", F.col("description").alias("response"), F.lit("yes").alias("gt"))).unionByName(x.select("description", F.lit(" ").alias("response"), F.lit("no").alias("gt")))
    return assess.statements(x, answers)


@query("select item_id as unit_id, 'yes' as gt, 'Is this statement true? Answer yes or no.' || chr(10) || text as prompt from benchmark where item_id % 4 <> 0 and trim(text) <> ''")
def judge_prompts(spark, d):
    """Units that have a loss are not judged again."""
    b = t(spark, d, "benchmark")
    units = b.select(F.col("item_id").alias("unit_id"), F.col("text").alias("description"), F.when(F.col("item_id") % 4 == 0, 0.5).alias("loss"))
    own = assess.statements(assess.descriptions(units, units), units.limit(0).select("description", F.lit("").alias("response"), F.lit("no").alias("gt")))
    return assess.judge_prompts(units, own).select("unit_id", "gt", "prompt")


@query("select round(avg(l_discount), 6) as mean_loss, count(l_discount) as judged from lineitem")
def mean_loss(spark, d):
    return assess.mean_loss(t(spark, d, "lineitem").select(F.col("l_discount").cast("double").alias("loss"))).select(F.round("mean_loss", 6).alias("mean_loss"), "judged")


@query("""with p as (select vec_id, list_filter(list_transform(embedding, lambda x: abs(x)::double), lambda x: x > 0) as p from embeddings)
select vec_id, round(list_avg(list_transform(p, lambda x: x / (x + 0.5))), 6) as confidence, round(list_sum(list_transform(p, lambda x: exp(-x))), 4) as probs from p""")
def candidate_confidence(spark, d):
    """Each token beside one other candidate of probability 0.5; candidates come as log-probabilities."""
    p = F.filter(F.transform("embedding", lambda x: F.abs(x).cast("double")), lambda x: x > 0)
    x = t(spark, d, "embeddings").select("vec_id", p.alias("p"))
    other = F.struct(F.lit(0.5).alias("prob"))
    tokens = F.transform("p", lambda x: F.struct(x.alias("prob"), F.array(F.struct(x.alias("prob")), other).alias("candidates")))
    logged = T.top_candidates(F.transform("p", lambda x: F.struct(F.lit("t").alias("token"), (-x).alias("logprob"))))
    return x.select("vec_id", F.round(T.mean_confidence(tokens), 6).alias("confidence"), F.round(F.aggregate(logged, F.lit(0.0), lambda a, y: a + y["prob"]), 4).alias("probs"))


@query("select item_id, length('question: ' || item_id || ' answer: ' || text)::double as score, (select avg(length('question: ' || item_id || ' answer: ' || text)) from benchmark)::double as avg, (select max(length('question: ' || item_id || ' answer: ' || text)) from benchmark)::double as max from benchmark")
def scored_pairs(spark, d):
    x = t(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("question"), F.col("text").alias("answer"))
    out = complete.scored(x, _lengths).select("item_id", "score")
    return out.crossJoin(F.broadcast(complete.score_summary(out).select("avg", "max")))  # one row


def _lengths(texts: list[str]) -> list[float]:
    return [float(len(x)) for x in texts]


# Parsing of every form of response; contents are digests, so that no content looks like a mark


_H = "md5(text)"


def _hashed(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("batch_id"), F.md5("text").alias("h"), (F.col("item_id") % 3).alias("k"))


def _by(*forms: str):
    """The form of a row by its number modulo the number of forms; @ stands for the row's digest."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("k") + 1).cast("int"))
    return F.replace(form, F.lit("@"), F.col("h"))


@query(f"select item_id as batch_id, case when item_id % 3 = 1 then {_H} || '?' else {_H} end as question from benchmark")
def parse_questions(spark, d):
    """Labelled, by a question mark, or the first line."""
    return parse.only_questions(_hashed(spark, d).withColumn("response", _by("**Question:** @\nmore", "Well\n@?", "\n@\nmore")))


@query(f"select item_id as batch_id, {_H} as answer from benchmark")
def parse_answers(spark, d):
    """Labelled, after a question's line, or the last paragraph."""
    return parse.only_answers(_hashed(spark, d).withColumn("response", _by("Answer: @", "Why so?\n@", "One.\n\n@")))


@query(f"select item_id as batch_id, {_H} as rephrased, case when item_id % 3 = 2 then '' else 'Q ' || {_H} end as question from benchmark")
def parse_aggregated(spark, d):
    return parse.aggregated_parts(_hashed(spark, d).withColumn("response", _by("Rephrased Text: @\nQuestion: Q @", "@\nQuestion: Q @", "@")))


@query(f"select item_id as batch_id, 'Q ' || {_H} as question, case when item_id % 3 = 0 then 'steps' else '' end as reasoning_path, case when item_id % 3 = 0 then 'think' when item_id % 3 = 1 then 'Question: Q ' || {_H} || chr(10) || chr(10) || 'body' else 'Question: Q ' || {_H} || chr(10) || 'Thought.' end as thinking_process, {_H} as final_answer from benchmark")
def parse_chain_of_thought(spark, d):
    """All labels; or the last paragraph, or the last sentence, is the final answer."""
    r = _by("Question: Q @\nReasoning Path: steps\nThinking Process: think\nFinal Answer: @", "Question: Q @\n\nbody\n\n@", "Question: Q @\nThought. @")
    return parse.chain_of_thought(_hashed(spark, d).withColumn("response", r)).withColumn("question", F.regexp_extract("question", r"^(Q [0-9a-f]+)", 1))


@query(f"select item_id as batch_id, 'Q ' || {_H} as question, {_H} as answer, case when item_id % 3 = 0 then 'levels' end as hierarchical_reasoning from benchmark where item_id % 3 < 2")
def parse_hierarchical(spark, d):
    return parse.hierarchical(_hashed(spark, d).withColumn("response", _by("Question: Q @\nAnswer: @\nHierarchical Reasoning: levels", "Question: Q @\nAnswer: @", "Question: Q @")))


@query(f"select item_id as batch_id, 'Q ' || {_H} as question, {_H} as answer from benchmark")
def parse_intent_pairs(spark, d):
    return parse.intent_pairs(_hashed(spark, d).withColumn("response", _by("Question: Q @\nAnswer: @", "Q @\n\n@", "Q @\n@")))


@query("select item_id, (item_id % 7)::double as overall_score, (item_id % 5)::double as accuracy, md5(text) as reason from benchmark")
def parse_reviewer_scores(spark, d):
    b = t(spark, d, "benchmark")
    body = F.to_json(F.struct((F.col("item_id") % 7).alias("overall_score"), (F.col("item_id") % 5).alias("accuracy"), F.md5("text").alias("reason")))
    return parse.reviewer_scores(b.select("item_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response")), parts=("accuracy",))


@query("with x as (select * from part) select p_partkey as doc_id, p_type as id, null as parent_id from x where p_partkey % 9 <> 0 union all select p_partkey, p_brand, p_type from x where p_partkey % 9 <> 0 union all select p_partkey, p_partkey::varchar, p_brand from x where p_partkey % 9 <> 0 union all select p_partkey, 'retry', null from x where p_partkey % 9 = 0")
def parse_taxonomy(spark, d):
    node = lambda i, kids: F.concat(F.lit('{"id": "'), i, F.lit('", "name": "n", "children": ['), kids, F.lit("]}"))
    tree = node(F.col("p_type"), node(F.col("p_brand"), node(F.col("p_partkey").cast("string"), F.lit(""))))
    r = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 9 == 0, "no tree").otherwise(F.concat(F.lit('{"nodes": ['), tree, F.lit("]}"))).alias("response"))
    rows, bad = parse.taxonomy_nodes(r)
    return rows.select("doc_id", "id", "parent_id").unionByName(bad.select("doc_id", F.lit("retry").alias("id"), F.lit(None).cast("string").alias("parent_id")))


@query("select item_id, least(item_id % 9, 5)::int as hops from benchmark")
def reasoning_hops(spark, d):
    n = (F.col("item_id") % 9).cast("int")
    edges = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return t(spark, d, "benchmark").select("item_id", parse.reasoning_hops(edges).alias("hops"))


@query("select s_suppkey as item_id, case when s_suppkey % 4 = 0 then 'saved' else 'raw' end as content, case when s_suppkey % 4 = 0 then 'approved' when s_suppkey % 3 = 0 then 'modified' else 'pending' end as review_status from supplier")
def merged_reviews(spark, d):
    key = F.col("s_suppkey")
    raw = t(spark, d, "supplier").select(key.alias("item_id"), F.lit("raw").alias("content"), F.when(key % 3 == 0, "modified").otherwise("pending").alias("review_status"))
    saved = raw.filter("item_id % 4 = 0").select("item_id", F.lit("saved").alias("content"), F.lit("approved").alias("review_status"))
    return E.merged_reviews(raw, saved).select("item_id", "content", "review_status")


# Taxonomies: samples by what every right sample shares


@query(f"""with {_TREE}, r as (select split_part(id, '/', 1) as root, count(*) as n from tree group by 1), k as (select (select count(*) from r) * 3 as k)
select 'rows' as what, k as n from k union all select 'roots', count(*) from r union all select 'most of a root', 3 from k union all select 'leaves', k from k""")
def balanced_branches(spark, d):
    """Three nodes for each root: all leaves, no root has more than its share."""
    tree = part_tree(spark, d)
    x = X.sample_branches(tree, 3 * X.roots(tree).count()).groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("is_leaf").cast("int")).alias("leaves")).agg(F.sum("n").alias("rows"), F.count("*").alias("roots"), F.max("n").alias("most of a root"), F.sum("leaves").alias("leaves"))
    return x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"`{c}`").cast("long").alias("n")) for c in x.columns])).alias("x")).select("x.*")


@query(f"with {_TREE}, s as (select count(*) filter (is_leaf) as leaves, count(*) filter (is_leaf and try_cast(split_part(id, '/', 3) as bigint) % 3 = 0) as covered, count(*) filter (not is_leaf) as inner_nodes from tree) select leaves - covered as new_leaves, inner_nodes as new_inner, 5::bigint as covered from s")
def uncovered_first(spark, d):
    """Five more than all that is uncovered: every uncovered node, and five covered ones."""
    tree = part_tree(spark, d)
    seen = tree.filter("id like '%/%/%' and cast(name as long) % 3 = 0").select("id")
    x = X.sample_uncovered(tree, seen, tree.count() - seen.count() + 5)
    return x.agg(F.count_if(F.expr("is_leaf and not covered")).alias("new_leaves"), F.count_if(F.expr("not is_leaf and not covered")).alias("new_inner"), F.count_if(F.col("covered")).alias("covered"))


@query(f"with {_TREE} select depth, count(*) as n from tree group by depth")
def sample_of_all_depths(spark, d):
    """A sample of as many as there are holds every node once."""
    tree = part_tree(spark, d)
    return X.sample_by_depth(tree, tree.count(), factor=2.0).distinct().groupBy("depth").agg(F.count("*").alias("n"))


@query("select s_suppkey::varchar as id, case when s_suppkey % 2 = 0 then 'new ' || s_name else s_name end as description from supplier")
def enriched_taxonomy(spark, d):
    tree = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("description"))
    return X.enriched(tree, tree.filter("cast(id as long) % 2 = 0").select("id", F.concat(F.lit("new "), "description").alias("description"))).select("id", "description")


@query("select doc_id, 'Derive a taxonomy of intents, as JSON with id, name, cognitive_dimension and children, from:' || chr(10) || text[1:15000] as prompt from documents")
def taxonomy_prompts(spark, d):
    """The first 15,000 characters are the operator's own limit."""
    return t(spark, d, "documents").select("doc_id", X.taxonomy_prompt(F.col("text")).alias("prompt"))


# Generation flows, with a stand-in for the model


@query("select item_id as batch_id, k::int as k, case when item_id % 5 = 0 then null else md5(text) || '?' end as question, case when item_id % 5 = 0 or k = 2 or item_id % 7 = 0 or i > 1 then null else 'A ' || md5(text) end as answer, case when item_id % 5 = 0 then 'no_question' when k = 2 or i > 1 then 'repeated' when item_id % 7 = 0 then 'no_answer' else 'ok' end as status from (select item_id, text, row_number() over (partition by text, item_id % 5 = 0 order by item_id) as i from benchmark), unnest([1, 2]) as u(k)")
def two_stage_pairs(spark, d):
    """Both questions of a batch are alike, so the second is a repeat; some batches give none, some questions no answer."""
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("batch_id"), F.col("text").alias("context"))

    def respond(x):
        key = F.col("batch_id")
        if "question" in x.columns:
            return x.withColumn("response", F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Answer: A "), F.md5("context"))))
        return x.withColumn("response", F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Question: "), F.md5("context"), F.lit("?"))))

    return generate.two_stage(b, respond, per_batch=2)


@query("select count(*) as n, count(*) as intents, 0.75::double as score, true as answered from nation")
def intent_generation(spark, d):
    """As many accepted pairs as there are nations, each for an intent of its own, though the critic refuses some."""
    p = t(spark, d, "part")
    nodes = p.select(F.concat(F.lit("P"), "p_partkey").alias("node_id"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("description"))
    edges = p.select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("B"), "p_brand").alias("tgt"))
    bad = F.pmod(F.hash("intent_id"), F.lit(5)) == 0
    respond = lambda x: x.withColumn("response", F.concat(F.lit("Question: Q "), F.md5("prompt"), F.lit("\nAnswer: "), F.md5("intent_id")))
    review = lambda x: x.withColumn("response", F.when(bad, '{"passed": false, "overall_score": 0.1}').otherwise('{"passed": true, "overall_score": 0.75}'))
    out = generate.intent_run(part_tree(spark, d), nodes, edges, respond, review, t(spark, d, "nation").count())
    return out.agg(F.count("*").alias("n"), F.countDistinct("intent_id").alias("intents"), F.min("score").alias("score"), F.every(F.col("answer") == F.md5("intent_id")).alias("answered"))
