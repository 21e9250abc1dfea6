"""Queries over items, responses, provenance, prompts by stage, and small stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, evaluation as E, parse, prompts, taxonomy as X
from .queries import query, t
from .queries_more import _QA, _QUALITY, _TREE, eval_rows, part_tree, qa_rows
from .sources import readers, tables


@query(f"""with {_QUALITY} select id, array_to_string(list_filter([case when qw < 5 then 'Expand the question to be more specific' when qw > 200 then 'Simplify the question' end, case when aw < 10 then 'Provide a more detailed answer' when aw > 500 then 'Condense the answer' end,
case when not regexp_matches(trim(question), '[?？]$') then 'Add a question mark at the end' end, case when aw = 0 then 'Provide a reference answer' end, case when not criteria then 'Add evaluation criteria for scoring' end], lambda x: x is not null), '; ') as suggestions from q""")
def item_suggestions(spark, d):
    return E.item_quality(eval_rows(spark, d)).select("id", F.array_join("suggestions", "; ").alias("suggestions"))


@query(f"""with {_QA} select conv_id, turn, trim(answer) as general, 'Question: ' || md5(question) || chr(10) || 'Answer: ' || md5(answer) as qa_pair, '[Text 1]' || chr(10) || md5(question) || chr(10) || '[Text 2]' || chr(10) || md5(answer) as text_markers,
'("entity"<|>"' || md5(question) || '"<|>"X"<|>"y")' as kg_extraction, '' as nothing, '   ' as blank from qa where trim(answer) <> ''""")
def repaired_responses(spark, d):
    """Answers inside fences and thoughts, and pairs, markers and records written carelessly, mended by kind."""
    x = qa_rows(spark, d).filter("trim(answer) <> ''").withColumns({"q": F.md5("question"), "a": F.md5("answer")})
    x = x.withColumns({
        "general": F.concat(F.lit("<think>so</think>\n```\n"), "answer", F.lit("\n```")), "qa_pair": F.concat(F.lit("**question**: "), "q", F.lit("\n## A: "), "a"),
        "text_markers": F.concat(F.lit("【text1】:\n"), "q", F.lit("\n**[ TEXT 2 ]**\n"), "a"), "kg_extraction": F.concat(F.lit('(entity<|>"'), "q", F.lit('"|"X"|"y")')), "nothing": F.lit(None).cast("string"), "blank": F.lit("   "),
    })
    done = {"general": T.repaired("general"), "qa_pair": T.repaired("qa_pair", "qa_pair"), "text_markers": T.repaired("text_markers", "text_markers", ["[Text 1]", "[Text 2]"]), "kg_extraction": T.repaired("kg_extraction", "kg_extraction"), "nothing": T.repaired("nothing"), "blank": T.repaired("blank")}
    return x.select("conv_id", "turn", *[c.alias(n) for n, c in done.items()]).withColumn("general", F.trim("general"))


@query("""with o as (select o_custkey as batch_id, o_orderkey, o_orderpriority, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) as i from orders)
select batch_id, count(*)::int as entity_count, (count(*) - 1)::int as relationship_count, (2 * count(*) - 1)::int as batch_size, string_agg('O' || o_orderkey, ',' order by o_orderkey) as entities, string_agg(o_orderpriority, ',' order by o_orderkey) as descriptions, string_agg(case when i > 1 then 'O' || o_orderkey end, ',' order by o_orderkey) as targets, 'atomic' as generation_mode, count(distinct o_orderpriority) > 0 as has_documents from o group by batch_id""")
def qa_context(spark, d):
    """A pair for each customer: its orders are the entities, each order follows the one before."""
    o = t(spark, d, "orders")
    nodes = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.concat(F.lit("O"), "o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("description"))))
    b = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(nodes.alias("n"), F.collect_set("o_orderpriority").alias("source_ids"))
    edges = F.zip_with(F.slice("n", F.lit(1), F.size("n") - 1), F.slice("n", F.lit(2), F.size("n")), lambda a, z: F.struct(a["node_id"].alias("src"), z["node_id"].alias("tgt")))
    b = b.select("batch_id", F.transform("n", lambda x: F.struct(x["node_id"].alias("node_id"), x["description"].alias("description"))).alias("nodes"), edges.alias("edges"), "source_ids")
    docs = o.select(F.col("o_orderpriority").alias("doc_id"), F.col("o_orderpriority").alias("content")).distinct()
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("full_doc_id"), "content")
    qa = parse.provenance(b.select(F.col("batch_id").alias("qa_id"), "batch_id"), b, chunks, docs)
    x = parse.with_context(qa, b, "atomic")
    return x.select(
        "batch_id", "graph.entity_count", "graph.relationship_count", "metadata.batch_size", F.array_join("graph.entities", ",").alias("entities"), F.array_join(F.transform("context.nodes", lambda n: n["description"]), ",").alias("descriptions"),
        F.when(F.size("context.edges") > 0, F.array_join(F.transform("context.edges", lambda e: e["target"]), ",")).alias("targets"), "metadata.generation_mode", "metadata.has_documents",
    )


def raw_multi_hop(spark, d):
    """Responses made of whole turns, labelled, partly labelled or not at all by turn; see tests for the plain parser."""
    x = qa_rows(spark, d)
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    text = F.when(kind == 0, F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\nReasoning Path: one, two"))).when(kind == 1, F.concat(F.lit("Answer: What is it?\n"), "answer")).otherwise(F.concat("question", F.lit("\n"), "answer"))
    return x.select(F.struct("conv_id", "turn").alias("batch_id"), text.alias("response"))


@query()
def parse_multi_hop_raw(spark, d):
    return parse.multi_hop(raw_multi_hop(spark, d)).select("batch_id.*", "question", "answer", "reasoning_path")


@query("with n as (select n_nationkey::bigint as ord, n_name as item from nation) select ord, item from n union all select (select max(ord) from n) + row_number() over (order by r_regionkey), r_name from region union all select -1, 'left ' || 0")
def list_store(spark, d):
    """Nations as a stored list, regions appended; and how many rows a dropped list has."""
    store = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("item"))
    more = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("item"))
    left = tables.dropped(store).agg(F.concat(F.lit("left "), F.count("*")).alias("item"))
    return tables.appended(store, more).select("ord", "item").unionByName(left.select(F.lit(-1).cast("long").alias("ord"), "item"))


@query("with s as (select case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'paused' end as status from orders) select coalesce(x.status, u.status) as status, coalesce(n, 0)::bigint as n from (select status, count(*) as n from s group by status union all select 'total', count(*) from s) x full join (select unnest(['pending', 'processing', 'auto_reviewing', 'completed', 'failed']) as status) u on x.status = u.status")
def task_states(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("paused")
    return E.task_summary(t(spark, d, "orders").select(state.alias("status")))


@query(f"with {_TREE}, one as (select min(id) as id from tree) select 'node' as what, id, null as parent_id from tree semi join one using (id) where depth = 0 union all select 'depth', id, parent_id from tree where depth = 1 union all select 'dimension', id, parent_id from tree where dim = '{X.DIMENSIONS[2]}'")
def taxonomy_access(spark, d):
    tree = part_tree(spark, d)
    first = tree.agg(F.min("id")).first()[0]
    pick = lambda df, what: df.select(F.lit(what).alias("what"), "id", "parent_id")
    return pick(X.node(tree, first), "node").unionByName(pick(X.at_depth(X.with_depth(tree), 1), "depth")).unionByName(pick(X.by_dimension(tree, X.DIMENSIONS[2]), "dimension"))


@query()
def token_chunks(spark, d):
    """Documents in chunks of at most 120 words and marks, 12 of them shared; tested against plain Python."""
    x = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.split_texts(x, "doc_id", "text", "en", 120, 12, starts=chunking.word_starts)


def _sql_list(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query(f"""with g(type, difficulty, guidance) as (values {_sql_list(prompts.GUIDANCE)}), w(type, template) as (values {_sql_list([(r[0], r[3]) for r in prompts.TEMPLATES if r[0] in prompts.EVAL_TYPES])})
select type, difficulty, n_nationkey::varchar as batch_id, replace(replace(template, '{{context}}', '- ' || n_name || ': ' || r_name), '{{difficulty}}', difficulty) || chr(10) || guidance || chr(10) || 'Items: ' || (n_nationkey % 3 + 1) as prompt from g join w using (type), nation join region on n_regionkey = r_regionkey""")
def guided_prompts(spark, d):
    """Every type and difficulty for each nation's facts."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<struct<src:string,tgt:string,description:string>>")
    batches = n.select(F.col("n_nationkey").cast("string").alias("batch_id"), F.array(F.struct(F.col("n_name").alias("node_id"), F.col("r_name").alias("description"))).alias("nodes"), none.alias("edges"))
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("difficulty")) for a, b, _ in prompts.GUIDANCE])).alias("k")
    planned = n.select(F.col("n_nationkey").cast("string").alias("batch_id"), (F.col("n_nationkey") % 3 + 1).alias("count"), kinds).select("batch_id", "count", "k.*")
    return prompts.eval_prompts(planned, batches, counts=True)


_STAGES = ("aggregated_question", "aggregated_combined", "cot_answer", "cot_combined")


@query(f"""with w(mode, template) as (values {_sql_list([(r[0], r[3]) for r in prompts.TEMPLATES if r[0] in _STAGES and r[1] == "en"])}), b as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)
select mode, n_nationkey::varchar as batch_id, replace(replace(replace(replace(replace(template, '{{entities}}', '1. ' || n_name || ': ' || r_name), '{{relations}}', '1. ' || n_name || ' -- ' || r_name || ': in'), '{{rephrased}}', n_name || ' lies in ' || r_name), '{{question}}', 'Where is ' || n_name || '?'), '{{path}}', 'look it up') as prompt from w, b""")
def stage_prompts(spark, d):
    """Prompts of the later and of the combined stages of a mode, filled with what the stage before gave."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = n.select(
        F.col("n_nationkey").cast("string").alias("batch_id"), F.array(F.struct(F.col("n_name").alias("node_id"), F.col("r_name").alias("description"))).alias("nodes"), F.array(F.struct(F.col("n_name").alias("src"), F.col("r_name").alias("tgt"), F.lit("in").alias("description"))).alias("edges"),
        F.concat_ws(" lies in ", "n_name", "r_name").alias("rephrased"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"),
    )
    out = [prompts.mode_prompts(b, m, rephrased=F.col("rephrased"), question=F.col("question"), path=F.lit("look it up")).select("mode", "batch_id", "prompt") for m in _STAGES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("select doc_id, 'Derive a taxonomy of intents, as JSON with id, name, cognitive_dimension and children, from:' || chr(10) || substr(text, 1, 15000) as prompt from documents")
def taxonomy_prompts(spark, d):
    return t(spark, d, "documents").select("doc_id", X.taxonomy_prompt(F.col("text")).alias("prompt"))


@query("select 'R' || r_regionkey as id, r_name as name, null as parent_id from region union all select 'N' || n_nationkey, n_name, 'R' || n_regionkey from nation union all select 'F' || n_nationkey, 'flat', 'N' || n_nationkey from nation")
def taxonomy_files(spark, d):
    """A tree for each region, nested, and its nations' own children, flat: rows of every level."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kid = F.struct(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    flat = F.struct(F.concat(F.lit("F"), "n_nationkey").alias("id"), F.lit("flat").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("parent_id"))
    x = n.groupBy("r_regionkey", "r_name").agg(F.collect_list(kid).alias("kids"), F.collect_list(flat).alias("flat"))
    text = F.concat(F.lit('{"nodes": ['), F.to_json(F.struct(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("kids").alias("children"))), F.lit(", "), F.regexp_replace(F.to_json("flat"), r"^\[|\]$", ""), F.lit("]}"))
    return readers.tree_rows(x.select(F.col("r_regionkey").alias("path"), F.try_parse_json(text).alias("v"))).select("id", "name", "parent_id")


@query("select item_id, md5(text) as found, '' as missing from benchmark")
def marked_part(spark, d):
    x = F.concat(F.lit("before <answer>\n "), F.md5("text"), F.lit(" \n</answer> after"))
    return t(spark, d, "benchmark").select("item_id", F.regexp_replace(T.between(x, "<answer>", "</answer>"), r"\s", "").alias("found"), T.between(F.col("text"), "<answer>", "</answer>").alias("missing"))
