"""Queries over partitions, prompts, question-answer pairs, evaluation, reviews, taxonomies and streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from . import graph as G
from .functions import text as T
from .operators import complete, evaluation as E, parse, partition as P, prompts, taxonomy as X
from .queries import _COMPONENTS, nation_graph, part_graph, query, t
from .sources import exports
from .streaming import ingest

# Partitions of the graph of customers, nations and regions


def nation_nodes(spark, d) -> DataFrame:
    c = t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.lit("customer").alias("entity_type"), F.col("c_mktsegment").alias("description"), F.abs("c_acctbal").alias("loss"))
    n = t(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node_id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("description"), F.lit(None).cast("double").alias("loss"))
    r = t(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node_id"), F.lit("region").alias("entity_type"), F.col("r_name").alias("description"), F.lit(None).cast("double").alias("loss"))
    return P.with_lengths(c.unionByName(n).unionByName(r))


def nation_edges(spark, d) -> DataFrame:
    return nation_graph(spark, d).withColumns({"description": F.concat_ws(" in ", "src", "tgt"), "length": F.lit(3).cast("long")})


_NODES = "nodes as (select 'C' || c_custkey as node_id, 'customer' as entity_type, c_mktsegment as description from customer union all select 'N' || n_nationkey, 'nation', n_name from nation union all select 'R' || r_regionkey, 'region', r_name from region)"
_EDGES = "edges as (select 'C' || c_custkey as src, 'N' || c_nationkey as tgt from customer union all select 'N' || n_nationkey, 'R' || n_regionkey from nation where n_nationkey % 2 = 0)"


@query(f"with {_NODES}, {_EDGES} select node_id as unit_id, 'node' as kind from nodes union all select src || chr(1) || tgt, 'edge' from edges")
def partition_atomic(spark, d):
    return P.bfs_communities(nation_nodes(spark, d), nation_edges(spark, d), 1).select("unit_id", "kind")


@query()
def partition_bfs(spark, d):
    return P.bfs_communities(nation_nodes(spark, d), nation_edges(spark, d), 5)


@query()
def partition_dfs(spark, d):
    return P.dfs_communities(nation_nodes(spark, d), nation_edges(spark, d), 4)


@query()
def partition_anchor(spark, d):
    return P.anchored_communities(nation_nodes(spark, d), nation_edges(spark, d), 6, anchor_type="nation")


@query()
def partition_ece(spark, d):
    return P.loss_communities(nation_nodes(spark, d), nation_edges(spark, d), 5, max_tokens=12, min_units=2, sampling="max_loss")


@query()
def partition_modularity(spark, d):
    return P.modularity_communities(nation_nodes(spark, d), nation_edges(spark, d), max_size=50)


@query()
def modularity_score(spark, d):
    e = nation_edges(spark, d)
    return P.modularity(e, P.modularity_communities(nation_nodes(spark, d), e))


@query(f"with {_COMPONENTS}, x as (select node, component, row_number() over (partition by component order by node) as i from k join m using (part)) select component || '#' || ((i - 1) // 20) as community_id, node as node_id from x")
def sliced_communities(spark, d):
    c = G.connected_components(nation_graph(spark, d))
    return P.sliced(c.select(F.col("component").alias("community_id"), F.col("node").alias("node_id")), 20)


@query("select n_name as src, r_name as tgt, 'part_of' as relation_type, true as is_hierarchy from nation join region on n_regionkey = r_regionkey union all select c_name, n_name, 'lives_in', false from customer join nation on c_nationkey = n_nationkey")
def hierarchy_edges(spark, d):
    n = t(spark, d, "nation")
    a = n.join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("tgt"), F.lit("part_of").alias("relation_type"))
    b = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("tgt"), F.lit("lives_in").alias("relation_type"))
    return P.hierarchy_edges(a.unionByName(b))


_SIBLINGS = "s as (select *, (row_number() over (partition by c_nationkey order by 'C' || c_custkey) - 1) // 10 as g from customer), q as (select *, count(*) over (partition by c_nationkey, g) as n from s)"


@query(f"with {_SIBLINGS} select 'N' || c_nationkey || '/' || g as community_id, 'C' || c_custkey as node_id, 'child' as role from q where n >= 2 union select 'N' || c_nationkey || '/' || g, 'N' || c_nationkey, 'parent' from q where n >= 2")
def sibling_groups(spark, d):
    e = t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("tgt"))
    return P.sibling_groups(e, 10)


@query("""with p as (select n_nationkey as n, n_regionkey as r, 'R' || n_regionkey || '>' || 'N' || n_nationkey as path from nation),
q as (select r, n, coalesce((select min(p.path || '>C' || c_custkey) from customer where c_nationkey = p.n), p.path) as path from p)
select path as community_id, 'N' || n as node_id, 1 as depth from q
union all select min(path), 'R' || r, 0 from q group by r
union all select p.path || '>C' || c_custkey, 'C' || c_custkey, 2 from customer join p on c_nationkey = n""")
def vertical_chains(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("tgt"))
    n = t(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("tgt"))
    return P.vertical_chains(c.unionByName(n), 3)


@query(f"with {_NODES}, {_EDGES}, {_SIBLINGS}, used as (select 'C' || c_custkey as node_id from q where n >= 2 union select 'N' || c_nationkey from q where n >= 2), ends as (select src as node_id from edges union select tgt from edges) select node_id as community_id, node_id, node_id in (select node_id from ends) as has_edges from nodes where node_id not in (select node_id from used)")
def leftover_nodes(spark, d):
    return P.leftovers(nation_nodes(spark, d), nation_edges(spark, d), sibling_groups(spark, d).select("node_id").distinct())


def nation_batches(spark, d) -> DataFrame:
    """One batch per nation: itself and its customers, and the edges between."""
    e = t(spark, d, "customer")
    key = F.concat(F.lit("N"), "c_nationkey")
    nodes = e.select(key.alias("community_id"), F.concat(F.lit("C"), "c_custkey").alias("unit_id"), F.lit("node").alias("kind")).unionByName(e.select(key.alias("community_id"), key.alias("unit_id"), F.lit("node").alias("kind")).distinct())
    edges = e.select(key.alias("community_id"), P.edge_unit(F.concat(F.lit("C"), "c_custkey"), key).alias("unit_id"), F.lit("edge").alias("kind"))
    return P.batches(nodes.unionByName(edges), nation_nodes(spark, d), nation_edges(spark, d))


_BULLETS = "b as (select 'N' || c_nationkey as batch_id, 'C' || c_custkey as c, c_mktsegment as about, n_name from customer join nation on c_nationkey = n_nationkey)"


@query(f"""with {_BULLETS} select batch_id, string_agg('- ' || c || ': ' || about, chr(10) order by c) || chr(10) || '- ' || batch_id || ': ' || any_value(n_name) || chr(10) ||
 string_agg('- ' || c || ' - ' || batch_id || ': ' || c || ' in ' || batch_id, chr(10) order by c) as context, 'en' as language from b group by batch_id""")
def batch_context(spark, d):
    x = nation_batches(spark, d)
    return x.select("batch_id", prompts.bullets().alias("context")).withColumn("language", T.main_language("context"))


@query(f"with {_BULLETS}, r as (select *, row_number() over (partition by batch_id order by c) as i from b) select batch_id, string_agg(i || '. ' || c || ' -- ' || batch_id || ': ' || c || ' in ' || batch_id, chr(10) order by i) as relations from r group by batch_id")
def numbered_relations(spark, d):
    return nation_batches(spark, d).select("batch_id", prompts.numbered_relations().alias("relations"))


@query(f"with {_BULLETS} select batch_id, min(c) || ',' || batch_id as nodes, min(c) || '>' || batch_id as edges from b group by batch_id")
def one_hop_batches(spark, d):
    x = prompts.one_hop(nation_batches(spark, d))
    return x.select("batch_id", F.array_join(F.transform("nodes", lambda n: n["node_id"]), ",").alias("nodes"), F.array_join(F.transform("edges", lambda e: F.concat(e["src"], F.lit(">"), e["tgt"])), ",").alias("edges"))


@query(f"with {_BULLETS}, k as (select distinct batch_id from b), r as (select *, row_number() over (order by batch_id) as i from k) select 'atomic' as mode, batch_id from r where i <= 13 union all select 'cot', batch_id from r where i <= 6")
def batches_by_mode(spark, d):
    return prompts.batches_by_mode(nation_batches(spark, d), {"atomic": 2.0, "cot": 1.0, "multi_hop": -1.0}, 15).select("mode", "batch_id")


@query(f"with {_BULLETS}, k as (select distinct batch_id from b), x as (select batch_id, u.turn::int as turn from k, (select unnest([0, 1, 2]) as turn) u) select batch_id, turn from x order by turn, batch_id limit 60")
def batch_budget(spark, d):
    return prompts.repeated_to(nation_batches(spark, d), target=40).select("batch_id", "turn")


_MULTI_HOP = next(r[3] for r in prompts.TEMPLATES if r[:2] == ("multi_hop", "en")).replace("'", "''")


@query(f"""with {_BULLETS}, u as (select batch_id, c as id, about from b union select batch_id, batch_id, n_name from b), n as (select batch_id, string_agg(i || '. ' || id || ': ' || about, chr(10) order by i) as entities from (select *, row_number() over (partition by batch_id order by id) as i from u) group by batch_id),
r as (select batch_id, string_agg(i || '. ' || c || ' -- ' || batch_id || ': ' || c || ' in ' || batch_id, chr(10) order by i) as relations from (select *, row_number() over (partition by batch_id order by c) as i from b) group by batch_id)
select batch_id, 'multi_hop' as mode, 'en' as language, replace(replace('{_MULTI_HOP}', '{{entities}}', entities), '{{relations}}', relations) as prompt from n join r using (batch_id)""")
def mode_prompts(spark, d):
    return prompts.mode_prompts(nation_batches(spark, d), "multi_hop")


@query("""select 'R' || r_regionkey as batch_id, '# ' || r_name || chr(10) || string_agg('## ' || n_name || chr(10) || 'nation ' || n_nationkey, chr(10) order by n_name) as text from region join nation on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def hierarchy_text(spark, d):
    x = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    batch = F.concat(F.lit("R"), "r_regionkey").alias("batch_id")
    nodes = x.select(batch, F.col("n_name").alias("node_id"), F.concat(F.lit("nation "), "n_nationkey").alias("description"))
    return prompts.hierarchy_text(nodes, x.select(batch, F.col("r_name").alias("src"), F.col("n_name").alias("tgt")))


@query("select case when 'C' || c_custkey = 'x' then '' else 'C' || c_custkey end as node_id, case when c_custkey % 4 = 0 then '/img/' || c_custkey || '.png' end as img_path from customer")
def image_attach(spark, d):
    c = t(spark, d, "customer")
    images = c.filter("c_custkey % 4 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("chunk_id"), F.concat(F.lit("/img/"), "c_custkey", F.lit(".png")).alias("img_path"))
    x = P.with_image(c.select(F.concat(F.lit('"C'), "c_custkey", F.lit('"')).alias("node_id")), images)
    return x.select(F.regexp_replace("node_id", '"', "").alias("node_id"), "img_path")


# Question-answer pairs: a user turn and the assistant's next one


def qa_rows(spark, d) -> DataFrame:
    c = t(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"]).withColumn("mode", F.when(F.col("conv_id") % 2 == 0, "atomic").otherwise("cot"))


_QA = "qa as (select u.conv_id, u.turn, u.text as question, a.text as answer, case when u.conv_id % 2 = 0 then 'atomic' else 'cot' end as mode from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user')"
_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9 .,?!]+', ' ', 'g'))"
_Q, _A = _PLAIN.format("question"), _PLAIN.format("answer")
_OK = f"{_Q} <> '' and {_A} <> ''"


def plain_qa(spark, d):
    """Questions and answers without the marks that responses are made of."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 .,?!]+", " "))
    return qa_rows(spark, d).withColumns({"question": plain("question"), "answer": plain("answer")})


@query(f"with {_QA} select conv_id, turn, 0 as pos, {_Q} as question, {_A} as answer from qa where {_OK}")
def parse_atomic(spark, d):
    x = plain_qa(spark, d)
    r = x.select(F.struct("conv_id", "turn").alias("batch_id"), F.concat(F.lit("**Question:** "), "question", F.lit("\n**Answer:** "), "answer").alias("response"))
    return parse.atomic_pairs(r).select("batch_id.*", "pos", "question", "answer")


@query(f"with {_QA} select conv_id, turn, {_Q} as question, {_A} as answer, 'step one' as reasoning_path from qa where {_OK}")
def parse_multi_hop(spark, d):
    x = plain_qa(spark, d)
    r = x.select(F.struct("conv_id", "turn").alias("batch_id"), F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\nReasoning Path: step one")).alias("response"))
    return parse.multi_hop(r).select("batch_id.*", "question", "answer", "reasoning_path")


@query("select item_id, (item_id % 3 <> 0) as passed, least(1.0, item_id % 13 / 10.0)::double as score, md5(text) as reason from benchmark")
def parse_critic(spark, d):
    b = t(spark, d, "benchmark")
    body = F.to_json(F.struct((F.col("item_id") % 3 != 0).alias("passed"), (F.col("item_id") % 13 / 10.0).alias("overall_score"), F.md5("text").alias("reason")))
    r = b.select("item_id", F.concat(F.lit("Here is my verdict:\n```json\n"), body, F.lit("\n```")).alias("response"))
    return parse.critic_verdicts(r).select("item_id", "passed", "score", "reason")


@query("select item_id, text as question, 'eval_know_' || substr(md5('knowledge_coverage:' || text), 1, 12) as id, md5(text) as reference_answer, 2 as distractors, 'ok' as status from benchmark where trim(text) <> ''")
def parse_eval_items(spark, d):
    b = t(spark, d, "benchmark")
    item = F.to_json(F.array(F.struct(F.col("text").alias("question"), F.md5("text").alias("reference_answer"), F.array(F.lit("a"), F.lit("b")).alias("distractors"))))
    r = b.select(F.lit("knowledge_coverage").alias("type"), F.lit("easy").alias("difficulty"), F.col("item_id").alias("batch_id"), item.alias("response"))
    return parse.eval_items(r).select(F.col("batch_id").alias("item_id"), "question", "id", "reference_answer", F.size("distractors").alias("distractors"), "status")


@query(f"with {_QA} select conv_id, turn, question as instruction, '' as input, answer as output, question as human, 'gpt' as second_speaker, 'user' as first_role from qa")
def qa_formats(spark, d):
    q = qa_rows(spark, d).withColumn("metadata", F.struct("conv_id", "turn"))
    a, s, c = exports.alpaca(q), exports.sharegpt(q), exports.chatml(q)
    a = a.select("metadata.*", "instruction", "input", "output")
    s = s.select("metadata.*", parse.question_of(s).alias("human"), F.element_at("conversations", 2)["from"].alias("second_speaker"))
    c = c.select("metadata.*", F.element_at("messages", 1)["role"].alias("first_role"))
    return a.join(s, ["conv_id", "turn"]).join(c, ["conv_id", "turn"])


@query(f"with {_QA}, x as (select *, row_number() over (partition by md5(mode || '::' || trim(question)) order by conv_id * 1000 + turn) as i from qa) select mode, count(*) as n from x where i = 1 or trim(question) = '' group by mode")
def qa_dedup(spark, d):
    q = qa_rows(spark, d).withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return parse.mode_counts(parse.without_repeats(q, "ord"))


@query("""with g as (select o_custkey as batch_id, list(distinct 'L' || o_orderkey order by 'L' || o_orderkey) as ids from orders group by o_custkey) select batch_id, len(ids)::int as chunks, (select count(distinct o_orderpriority) from orders o where o.o_custkey = g.batch_id)::int as documents from g""")
def provenance(spark, d):
    o = t(spark, d, "orders")
    b = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.collect_set(F.concat(F.lit("L"), "o_orderkey")).alias("source_ids"))
    chunks = o.select(F.concat(F.lit("L"), "o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("full_doc_id"), F.col("o_orderstatus").alias("content"))
    docs = o.select(F.col("o_orderpriority").alias("doc_id"), F.col("o_orderpriority").alias("content")).distinct()
    x = parse.provenance(b.select(F.col("batch_id").alias("qa_id"), "batch_id"), b, chunks, docs)
    return x.select("batch_id", F.size("source_chunks").alias("chunks"), F.size("source_documents").alias("documents"))


@query(f"with {_QA} select conv_id::varchar as conv_id, turn::varchar as turn, mode, coalesce(question, '') as question, '' as reviewer from qa")
def flat_export(spark, d):
    return exports.flat(qa_rows(spark, d), ["conv_id", "turn", "mode", "question", "reviewer"], [])


# Evaluation items


def eval_rows(spark, d) -> DataFrame:
    i = F.col("conv_id") * 1000 + F.col("turn")
    x = qa_rows(spark, d).select(
        i.alias("id"), F.element_at(F.array(*map(F.lit, prompts.EVAL_TYPES)), (F.col("conv_id") % 4 + 1).cast("int")).alias("type"), "question", F.col("answer").alias("reference_answer"),
        F.element_at(F.array(*map(F.lit, E.DIFFICULTIES)), (F.col("turn") % 3 + 1).cast("int")).alias("difficulty"), (F.col("conv_id") % 7).alias("reasoning_hops"),
        F.slice(F.array(*[F.lit(f"n{k}") for k in range(6)]), F.lit(1), (F.col("conv_id") % 6).cast("int")).alias("knowledge_nodes"), F.slice(F.array(*[F.lit(f"d{k}") for k in range(4)]), F.lit(1), (F.col("conv_id") % 4).cast("int")).alias("distractors"),
        F.when(F.col("conv_id") % 5 > 0, F.create_map(F.lit("k"), F.lit("v"))).alias("evaluation_criteria"),
    )
    return x


_ITEMS = f"""{_QA}, items as (select conv_id * 1000 + turn as id, ['knowledge_coverage', 'reasoning_ability', 'factual_accuracy', 'comprehensive'][conv_id % 4 + 1] as type, question, answer as reference_answer,
 ['easy', 'medium', 'hard'][turn % 3 + 1] as difficulty, conv_id % 7 as hops, conv_id % 6 as points, conv_id % 4 as distractors, conv_id % 5 > 0 as criteria, len(regexp_extract_all(question, '\\S+')) as qw, len(regexp_extract_all(answer, '\\S+')) as aw from qa)"""


@query(f"with {_ITEMS}, n as (select count(*)::double as n from items) select 'type' as what, type as value, count(*) as n, count(*) / any_value(n.n) as share from items, n group by type union all select 'difficulty', difficulty, count(*), count(*) / any_value(n.n) from items, n group by difficulty union all select 'total', null, count(*), 1.0::double from items")
def eval_statistics(spark, d):
    return E.dataset_statistics(eval_rows(spark, d))


_SCORE = """(case when hops > 0 then least(hops / 5.0, 1) * 0.3 else 0 end + case when points > 0 then least(points / 10.0, 1) * 0.2 else 0 end + least(qw / 50.0, 1) * 0.15 + least(aw / 100.0, 1) * 0.15 + case when distractors > 0 then least(distractors / 5.0, 1) * 0.2 else 0 end)
 / (0.3 + case when hops > 0 then 0.3 else 0 end + case when points > 0 then 0.2 else 0 end + case when distractors > 0 then 0.2 else 0 end)"""


@query(f"with {_ITEMS} select id, round({_SCORE}::double, 6) as score from items")
def difficulty_scores(spark, d):
    return E.difficulty_scores(eval_rows(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"with {_ITEMS}, s as (select {_SCORE}::double as score from items) select case when score < 0.4 then 'easy' when score < 0.7 then 'medium' else 'hard' end as level, count(*) as n, round(avg(score), 6) as avg_score from s group by 1")
def difficulty_report(spark, d):
    return E.difficulty_report(E.difficulty_scores(eval_rows(spark, d))).withColumn("avg_score", F.round("avg_score", 6))


_QUALITY = f"""{_ITEMS}, q as (select *, greatest(0, least(1, round(1 - (case when qw < 5 then 0.2 when qw > 200 then 0.1 else 0 end + case when aw < 10 then 0.2 when aw > 500 then 0.1 else 0 end + case when regexp_matches(trim(question), '[?？]$') then 0 else 0.05 end
 + case when aw = 0 then 0.5 else 0 end + case when criteria then 0 else 0.1 end + case when points > 0 then 0 else 0.05 end), 9)))::double as quality, aw > 0 as has_answer from items)"""


@query(f"with {_QUALITY} select id, quality, (quality >= 0.5 and has_answer) as is_valid from q")
def item_quality(spark, d):
    return E.item_quality(eval_rows(spark, d)).select("id", "quality", "is_valid")


@query(f"with {_QUALITY} select count(*) as total_items, count(*) filter (quality >= 0.5 and has_answer) as valid_items, round(avg(quality), 6) as average_quality, count(*) filter (quality >= 0.8) as high from q")
def dataset_quality(spark, d):
    x = E.dataset_quality(E.item_quality(eval_rows(spark, d)))
    return x.select("total_items", "valid_items", F.round("average_quality", 6).alias("average_quality"), "high")


@query(f"with {_QUALITY}, i as (select case when qw < 5 then 'Question too short (' || qw || ' words)' when qw > 200 then 'Question too long (' || qw || ' words)' end as issue from q union all select case when aw < 10 then 'Answer too short (' || aw || ' words)' when aw > 500 then 'Answer too long (' || aw || ' words)' end from q union all select case when not regexp_matches(trim(question), '[?？]$') then 'Question doesn''t end with a question mark' end from q union all select case when aw = 0 then 'Answer is empty' end from q union all select case when not criteria then 'Missing evaluation criteria' end from q union all select case when points = 0 then 'Missing knowledge node information' end from q) select issue, count(*) as n from i where issue is not null group by issue order by n desc, issue limit 5")
def top_issues(spark, d):
    return E.issue_counts(E.item_quality(eval_rows(spark, d)))


@query(f"with {_ITEMS} select round((count(distinct type) / 4.0 + count(distinct difficulty) / 3.0 + count(distinct lower(regexp_extract(question, '^\\s*(\\S+)', 1))) / count(*)::double) / 3.0, 6)::double as diversity from items")
def eval_diversity(spark, d):
    return E.diversity(eval_rows(spark, d)).select(F.round("diversity", 6).alias("diversity"))


@query(f"with {_QUALITY} select id from q where quality >= 0.6 and quality >= 0.5 and has_answer")
def good_items(spark, d):
    return E.good_items(E.item_quality(eval_rows(spark, d)), 0.6).select("id")


@query(f"with {_ITEMS}, x as (select *, row_number() over (partition by lower(trim(question)) order by id) as i from items) select id from x where i = 1")
def distinct_questions(spark, d):
    return E.distinct_questions(eval_rows(spark, d), "id").select("id")


@query(f"with {_ITEMS} select id, distractors::int + 1 as options from items where distractors > 0")
def multiple_choice(spark, d):
    return exports.multiple_choice(eval_rows(spark, d)).select("id", F.size("options").alias("options"))


@query("select 'knowledge_coverage' as type, 'easy' as difficulty, 5 as count, turn::int as turn, ((0 + turn) % 25)::varchar as batch_id from (select unnest([0, 1]) as turn) union all select 'knowledge_coverage', 'hard', 5, turn, ((2 + turn) % 25)::varchar from (select unnest([0, 1]) as turn) union all select 'comprehensive', 'easy', 5, turn, ((4 + turn) % 25)::varchar from (select unnest([0, 1]) as turn) union all select 'comprehensive', 'hard', 5, turn, ((6 + turn) % 25)::varchar from (select unnest([0, 1]) as turn)")
def eval_plan(spark, d):
    b = t(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("batch_id"))
    x = E.eval_plan(b, {"knowledge_coverage": 0.5, "comprehensive": 0.5}, {"easy": 0.5, "hard": 0.5}, 20)
    return x.select("type", "difficulty", "count", "turn", F.col("batch_id").cast("int").cast("string").alias("batch_id"))


@query("select lang, count(*) as docs, round(avg(n), 6) as avg, min(n) as min, max(n) as max from (select lang, len(regexp_extract_all(text, '\\S+'))::bigint as n from documents) group by lang")
def length_stats(spark, d):
    x = E.length_statistics(t(spark, d, "documents"), ["lang"], F.regexp_count("text", F.lit(r"\S+")))
    return x.select("lang", "docs", F.round("avg", 6).alias("avg"), "min", "max")


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(T.STOPWORDS))


@query(rf"""with recursive a as (select conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w not in ({_STOP})) as t from conversations),
tk as (select conv_id, turn, 0 as back, t from a union all select conv_id, turn, 1, list_reverse(t) from a),
r as (select conv_id, turn, back, 0 as i, 0 as since, 0 as types, 0 as f from tk union all
select conv_id, turn, back, i + 1, case when whole then i + 1 else since end, case when whole then 0 else k end, f + whole::int from (select *, k / (i + 1 - since)::double <= 0.72 as whole from (select r.*, types + (not list_contains(t[since + 1 : i], t[i + 1]))::int as k from r join tk using (conv_id, turn, back) where i < len(t)))),
e as (select conv_id, turn, i, f + case when i > since then 1 - (types / (i - since)::double - 0.72) / (1 - 0.72) else 0 end as f from r join tk using (conv_id, turn, back) where i = len(t))
select conv_id, turn, round(avg(case when i = 0 then 0 when f > 0 then i / f else i end), 6) as mtld from e group by conv_id, turn""")
def mtld_scores(spark, d):
    tokens = E.content_tokens("text", T.STOPWORDS)
    return t(spark, d, "conversations").select("conv_id", "turn", F.round(E.mtld(tokens), 6).alias("mtld"))


# Coverage of the part graph


@query("""with e as (select distinct l_partkey as p, l_suppkey as s, l_orderkey as o from lineitem), n as (select p, s, count(distinct o) as occ from e group by p, s) select count(*) as long_tail, count(*) filter (p % 3 = 0) as covered, round(count(*) filter (p % 3 = 0) / count(*)::double, 6) as share from n where occ <= 5""")
def long_tail_coverage(spark, d):
    l = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    counts = l.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("occurrences"))
    covered = l.filter("l_partkey % 3 = 0").select("l_partkey", "l_suppkey")
    x = E.long_tail(counts, covered, ["l_partkey", "l_suppkey"])
    return x.select("long_tail", "covered", F.round("share", 6).alias("share"))


@query("with e as (select distinct 'P' || l_partkey as src, 'S' || l_suppkey as tgt from lineitem), a as (select src, count(*) as k from e group by src), b as (select tgt, count(*) as k from e group by tgt) select src, tgt from e join a using (src) join b using (tgt) where greatest(a.k, b.k) > 1")
def complex_relations(spark, d):
    """In a two-sided graph no two ends of a wedge are adjacent."""
    return E.on_paths_of_two(part_graph(spark, d))


@query(f"""with {_EDGES}, s as (select src as u, tgt as v from edges union select tgt, src from edges),
q as (select c_custkey as qa_id, 'C' || c_custkey as node_id from customer union all select c_custkey, 'N' || c_nationkey from customer union all select c_custkey, 'R' || n_regionkey from customer join nation on n_nationkey = c_nationkey),
pairs as (select x.qa_id, x.node_id as a, y.node_id as b from q x join q y on x.qa_id = y.qa_id and x.node_id < y.node_id),
h as (select qa_id, 1 as hops from pairs semi join s on u = a and v = b union all select qa_id, 2 from pairs anti join s on u = a and v = b where exists (select 1 from s x join s y on x.v = y.u where x.u = a and y.v = b))
select qa_id::bigint as qa_id, round(avg(hops), 6) as mean_hops from h group by qa_id""")
def mean_hops(spark, d):
    """Per customer: the customer, its nation and its region; regions of odd nations are out of reach."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.explode(F.array(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("R"), "n_regionkey")))
    q = c.select(F.col("c_custkey").cast("long").alias("qa_id"), name.alias("node_id"))
    return E.mean_hops(q, nation_graph(spark, d), 2).withColumn("mean_hops", F.round("mean_hops", 6))


@query("""with e as (select distinct 'C' || o_custkey as src, 'P' || o_orderpriority as tgt from orders union select 'C' || c_custkey, 'N' || c_nationkey from customer union select distinct 'P' || o_orderpriority, 'N' || c_nationkey from orders join customer on o_custkey = c_custkey where c_nationkey % 2 = 0),
s as (select src as u, tgt as v from e union select tgt, src from e), x as (select least(src, tgt) as src, greatest(src, tgt) as tgt from e),
w as (select a.u, a.v from s a join s b on a.v = b.u and b.v <> a.u anti join s c on c.u = a.u and c.v = b.v)
select src, tgt from x where exists (select 1 from w where u = src and v = tgt) or exists (select 1 from w where u = tgt and v = src)""")
def complex_relations_mixed(spark, d):
    """A graph with triangles: customers, the priorities of their orders, their nations."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    name = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    e = o.select(name("C", "o_custkey").alias("src"), name("P", "o_orderpriority").alias("tgt")).unionByName(c.select(name("C", "c_custkey").alias("src"), name("N", "c_nationkey").alias("tgt")))
    even = o.join(c.filter("c_nationkey % 2 = 0"), o["o_custkey"] == c["c_custkey"])
    return E.on_paths_of_two(e.unionByName(even.select(name("P", "o_orderpriority").alias("src"), name("N", "c_nationkey").alias("tgt"))))


# Critics and reviews

_RULES = f"{_QA}, r as (select *, length(trim(answer)) >= 20 as a, length(trim(question)) >= 10 as b, lower(trim(question)) <> lower(trim(answer)) as c from qa)"


@query(f"with {_RULES} select conv_id, turn, round((a::int + b::int + c::int * 1.5) / 3.5, 6)::double as score, (a and b and c) as passed from r")
def rule_critic(spark, d):
    return E.rule_critic(qa_rows(spark, d), E.usual_rules()).select("conv_id", "turn", F.round("score", 6).alias("score"), "passed")


@query(f"with {_RULES} select conv_id, turn from r where a and b and c")
def critic_filter(spark, d):
    return E.accepted(E.rule_critic(qa_rows(spark, d), E.usual_rules())).select("conv_id", "turn")


def review_items(spark, d) -> DataFrame:
    x = t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.struct(F.col("lang"), F.col("source")).alias("content"), F.lit("pending").alias("review_status"))
    return x


def review_actions(spark, d) -> DataFrame:
    """Each label is two actions; later ones win; unknown items get some too."""
    l = t(spark, d, "labels")
    a = l.select(F.col("doc_id").alias("item_id"), F.lit("rejected").alias("review_status"), F.lit(1).alias("review_time"))
    b = l.filter("quality = 1").select(F.col("doc_id").alias("item_id"), F.lit("approved").alias("review_status"), F.lit(2).alias("review_time"))
    c = l.select((-F.col("doc_id") - 1).alias("item_id"), F.lit("approved").alias("review_status"), F.lit(3).alias("review_time"))
    return a.unionByName(b).unionByName(c)


_REVIEW = "r as (select doc_id as item_id, lang, source, case when q is null then 'pending' when q = 1 then 'approved' else 'rejected' end as review_status from documents left join (select doc_id, max(quality) as q from labels group by doc_id) using (doc_id))"


@query(f"with {_REVIEW} select item_id, review_status from r")
def review_latest(spark, d):
    return E.review(review_items(spark, d), review_actions(spark, d))[0].select("item_id", "review_status")


@query("select distinct -doc_id - 1 as item_id from labels")
def review_unknown(spark, d):
    return E.review(review_items(spark, d), review_actions(spark, d))[1].select("item_id")


@query(f"with {_REVIEW}, s as (select unnest(['pending', 'approved', 'rejected', 'modified', 'auto_approved', 'auto_rejected']) as review_status) select s.review_status, count(r.item_id) as n from s left join r using (review_status) group by 1")
def review_stats(spark, d):
    return E.review_counts(E.review(review_items(spark, d), review_actions(spark, d))[0])


@query("select doc_id, case when doc_id % 100 / 100.0 >= 0.7 then 'auto_approved' when doc_id % 100 / 100.0 < 0.5 then 'auto_rejected' else 'pending' end as status from documents")
def auto_review(spark, d):
    return t(spark, d, "documents").select("doc_id", E.auto_status((F.col("doc_id") % 100).cast("decimal(10,2)") / 100, 0.7, reject=True).alias("status"))


@query(f"with {_REVIEW} select item_id, lang, source, review_status from r where review_status = 'approved'")
def reviewed_export(spark, d):
    x = E.review(review_items(spark, d), review_actions(spark, d))[0]
    x = x.withColumns({"modified_content": F.lit(None).cast(x.schema["content"].dataType), "review_comment": F.lit(""), "reviewer": F.lit("")})
    return exports.reviewed(x, ["approved"]).select("item_id", "lang", "source", "review_status")


@query("select l_shipmode as model, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, sum(tokens)::bigint as tokens from (select l_returnflag as l_shipmode, l_linestatus = 'F' as ok, l_linenumber as tokens from lineitem) group by grouping sets ((l_shipmode), ())")
def run_summary(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_linenumber").alias("tokens"), F.col("l_quantity").alias("seconds"))
    return E.run_summary(x).select("model", "succeeded", "failed", "tokens")


# Taxonomy: part types as a tree of three levels


def part_tree(spark, d) -> DataFrame:
    p = t(spark, d, "part").select("p_type", "p_brand", "p_partkey").withColumn("k", (F.length("p_type") % 6).cast("int"))
    dim = F.element_at(F.array(*map(F.lit, X.DIMENSIONS)), F.col("k") + 1)
    null = F.lit(None).cast("string")
    top = p.select(F.col("p_type").alias("id"), F.col("p_type").alias("name"), null.alias("description"), dim.alias("cognitive_dimension"), null.alias("parent_id")).distinct()
    mid = p.select(F.concat_ws("/", "p_type", "p_brand").alias("id"), F.col("p_brand").alias("name"), null.alias("description"), dim.alias("cognitive_dimension"), F.col("p_type").alias("parent_id")).distinct()
    low = p.select(F.concat_ws("/", "p_type", "p_brand", "p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("name"), null.alias("description"), dim.alias("cognitive_dimension"), F.concat_ws("/", "p_type", "p_brand").alias("parent_id"))
    return top.unionByName(mid).unionByName(low)


_DIM = "[" + ", ".join(f"'{x}'" for x in X.DIMENSIONS) + "][length(p_type) % 6 + 1]"
_TREE = f"tree as (select distinct p_type as id, null as parent_id, 0 as depth, false as is_leaf, {_DIM} as dim from part union all select distinct p_type || '/' || p_brand, p_type, 1, false, {_DIM} from part union all select p_type || '/' || p_brand || '/' || p_partkey, p_type || '/' || p_brand, 2, true, {_DIM} from part)"


@query(f"with {_TREE} select id, depth, is_leaf from tree")
def taxonomy_depths(spark, d):
    return X.with_depth(part_tree(spark, d)).select("id", "depth", "is_leaf")


@query(f"with {_TREE} select id as ancestor, id, 0 as distance from tree union all select parent_id, id, 1 from tree where parent_id is not null union all select a.parent_id, b.id, 2 from tree b join tree a on a.id = b.parent_id where a.parent_id is not null")
def taxonomy_closure(spark, d):
    return X.closure(part_tree(spark, d))


@query(f"""with {_TREE} select 'WARNING' as level, 'orphan' as rule, 'x/' || p_partkey as id from part where p_partkey % 50 = 0 union all select 'WARNING', 'unknown_dimension', 'd/' || p_partkey from part where p_partkey % 70 = 0
union all select 'WARNING', 'too_deep', 'c/' || n_nationkey from nation where n_nationkey > 10 union all select 'ERROR', 'unreachable', 'u/' || r_regionkey from region""")
def taxonomy_issues(spark, d):
    """The tree of parts with orphans, odd dimensions, a chain of nations, and regions that go round."""
    p, n, r = t(spark, d, "part"), t(spark, d, "nation"), t(spark, d, "region")
    row = lambda df, mark, key, dim, parent: df.select(F.concat(F.lit(mark), key).alias("id"), F.lit(mark).alias("name"), F.lit(None).cast("string").alias("description"), F.lit(dim).alias("cognitive_dimension"), parent.alias("parent_id"))
    bad = row(p.filter("p_partkey % 50 = 0"), "x/", "p_partkey", X.DIMENSIONS[0], F.lit("nowhere"))
    bad = bad.unionByName(row(p.filter("p_partkey % 70 = 0"), "d/", "p_partkey", "odd", F.col("p_type")))
    bad = bad.unionByName(row(n, "c/", "n_nationkey", X.DIMENSIONS[1], F.when(F.col("n_nationkey") > 0, F.concat(F.lit("c/"), (F.col("n_nationkey") - 1).cast("string")))))
    bad = bad.unionByName(row(r, "u/", "r_regionkey", X.DIMENSIONS[1], F.concat(F.lit("u/"), ((F.col("r_regionkey") + 1) % F.lit(r.count())).cast("string"))))
    return X.validate(part_tree(spark, d).unionByName(bad))


@query(f"with {_TREE} select 'depth' as what, depth::varchar as value, count(*) as n from tree group by depth union all select 'dimension', dim, count(*) from tree group by dim union all select 'nodes', null, count(*) from tree union all select 'leaves', null, count(*) filter (is_leaf) from tree")
def taxonomy_statistics(spark, d):
    return X.statistics(part_tree(spark, d))


@query(f"""with {_TREE}, x as (select *, (is_leaf and try_cast(split_part(id, '/', 3) as bigint) % 3 = 0)::int as c from tree)
select 'overall' as what, null as value, count(*) as n, sum(c)::bigint as covered, round(avg(c), 6) as ratio from x union all select 'leaf', null, count(*), sum(c)::bigint, round(avg(c), 6) from x where is_leaf
union all select 'dimension', dim, count(*), sum(c)::bigint, round(avg(c), 6) from x group by dim union all select 'depth', depth::varchar, count(*), sum(c)::bigint, round(avg(c), 6) from x group by depth""")
def taxonomy_coverage(spark, d):
    tree = part_tree(spark, d)
    seen = tree.filter("id like '%/%/%' and cast(name as long) % 3 = 0").select("id")
    return X.coverage(tree, seen).select("what", "value", "n", "covered", F.round("ratio", 6).alias("ratio"))


@query(f"with {_TREE} select id, parent_id, count(*) over (partition by coalesce(parent_id, '-')) - 1 as siblings from tree")
def taxonomy_siblings(spark, d):
    return X.sibling_counts(part_tree(spark, d))


@query(f"""with {_TREE}, x as (select *, split_part(id, '/', 1) as root, case depth when 0 then [id] when 1 then [parent_id, id] else [split_part(id, '/', 1), parent_id, id] end as path, case when is_leaf then split_part(id, '/', 3) when depth = 1 then split_part(id, '/', 2) else id end as name from tree),
y as (select *, row_number() over (partition by root order by path) - 1 as place, row_number() over (partition by coalesce(parent_id, id) || depth order by id) as nth, 1 + case depth when 0 then (select count(*) from x k where k.root = x.id) - 1 when 1 then (select count(*) from x k where k.parent_id = x.id) else 0 end as size from x)
select root, (2 * place - depth)::bigint as at, case when depth > 0 and nth > 1 then ',' else '' end || '{{"id":"' || id || '","name":"' || name || '","cognitive_dimension":"' || dim || '","children":[' as piece from y union all select root, (2 * place - depth + 2 * size - 1)::bigint, ']}}' from y""")
def taxonomy_nested(spark, d):
    return X.nested_json(part_tree(spark, d))


@query()
def sample_branches(spark, d):
    return X.sample_branches(part_tree(spark, d), 40)


@query()
def sample_by_depth(spark, d):
    return X.sample_by_depth(part_tree(spark, d), 40)


@query()
def sample_uncovered(spark, d):
    tree = part_tree(spark, d)
    return X.sample_uncovered(tree, tree.filter("id like '%/%/%' and cast(name as long) % 3 = 0"), 40)


_KEYWORDS = "k as (select n_nationkey as intent_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(n_name || ' ' || r_name || ' supplier overseas'), '[a-z]+'), lambda w: length(w) > 1))) as kw from nation join region on n_regionkey = r_regionkey), n as (select 'S' || s_suppkey as node_id, lower('S' || s_suppkey || ' ' || s_name || ' ' || n_name) as hay from supplier join nation on s_nationkey = n_nationkey)"


@query(f"""with {_KEYWORDS}, tot as (select intent_id, count(*) as n from k group by 1), h as (select intent_id, node_id, count(*) as m from k join n on contains(hay, kw) group by 1, 2),
s as (select intent_id, node_id, m / tot.n::double as score, row_number() over (partition by intent_id order by m / tot.n::double desc, node_id) as rank from h join tot using (intent_id)) select intent_id, node_id, round(score, 6) as score, rank::int as rank from s where rank <= 5 and score >= 0.1""")
def intent_link(spark, d):
    n = t(spark, d, "nation")
    r = n.join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    intents = r.select(F.col("n_nationkey").alias("intent_id"), F.concat_ws(" ", "n_name", "r_name", F.lit("supplier overseas")).alias("text"))
    s = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = s.select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"), F.col("s_name").alias("description"), F.col("n_name").alias("entity_type"))
    return X.link_intents(intents, nodes).withColumn("score", F.round("score", 6))


@query(f"""with {_NODES}, {_EDGES}, k as (select r_regionkey as intent_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(r_name), '[a-z]+'), lambda w: length(w) > 1))) as kw from region), tot as (select intent_id, count(*) as n from k group by 1),
h as (select intent_id, node_id, count(*) / any_value(tot.n)::double as score from k join tot using (intent_id) join nodes on contains(lower(node_id || ' ' || description || ' ' || entity_type), kw) group by 1, 2),
s as (select intent_id, node_id from (select *, row_number() over (partition by intent_id order by score desc, node_id) as i from h where score >= 0.1) where i <= 5),
b as (select src as u, tgt as v from edges union select tgt, src from edges), g as (select intent_id, node_id, min(hop) as hop from (select intent_id, node_id, 0 as hop from s union all select intent_id, v, 1 from s join b on u = node_id) group by 1, 2),
q as (select intent_id, node_id from (select *, row_number() over (partition by intent_id order by hop, node_id) as i from g) where i <= 20),
l as (select intent_id, 0 as part, '- ' || node_id || ': ' || description as line from q join nodes using (node_id) union all select x.intent_id, 1, '- ' || src || ' - ' || tgt from edges join q x on x.node_id = src join q y on y.node_id = tgt and y.intent_id = x.intent_id)
select intent_id, string_agg(line, chr(10) order by part, line) as text from l group by intent_id""")
def intent_subgraph(spark, d):
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("intent_id"), F.col("r_name").alias("text"))
    return X.intent_subgraphs(r, nation_nodes(spark, d), nation_edges(spark, d), 1, 20)


@query("with x as (select p_brand as cognitive_dimension, count(*) as n from part group by 1) select cognitive_dimension, n, round(n / (sum(n) over ())::double, 6) as share from x")
def dimension_shares(spark, d):
    x = X.dimension_shares(t(spark, d, "part").select(F.col("p_brand").alias("cognitive_dimension")))
    return x.withColumn("share", F.round("share", 6))


# Model calls, caches, streams


def _prompts(spark, d) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))


@query("select conv_id, turn, case when text in (select text from conversations where turn = 0 and conv_id % 2 = 0) then 'hit' else 'miss' end as state from conversations")
def prompt_cache(spark, d):
    p = _prompts(spark, d)
    cache = p.filter("turn = 0 and conv_id % 2 = 0").select(complete.prompt_key(p).alias("key"), F.lit("r").alias("response"), F.lit("2024-01-01").cast("timestamp").alias("ts")).dropDuplicates(["key"])
    hits, _ = complete.with_cache(p, cache, F.lit("2024-01-01 00:10:00"), 3600)
    x = p.join(hits.select("conv_id", "turn", F.lit("hit").alias("state")), ["conv_id", "turn"], "left")
    return x.select("conv_id", "turn", F.coalesce("state", F.lit("miss")).alias("state"))


def _digests(texts: list[str]) -> list[str]:
    return [hashlib.md5(x.encode()).hexdigest() if x and x.strip() else "" for x in texts]


@query("select conv_id, turn, case when regexp_matches(text, '\\S') then md5(text) else '' end as response, case when regexp_matches(text, '\\S') then 'ok' else 'empty' end as status from conversations")
def model_calls(spark, d):
    x = complete.complete(_prompts(spark, d), _digests)
    return x.select("conv_id", "turn", "response", "status")


@query("select role, sum(length(text))::bigint as prompt_tokens, sum(turn)::bigint as completion_tokens, sum(length(text) + turn)::bigint as total_tokens from conversations group by role")
def usage_totals(spark, d):
    x = t(spark, d, "conversations").select("role", F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens"))
    return complete.usage_totals(x, ["role"])


@query("select date_trunc('minute', ts) as minute, count(*) as requests, sum(floor(value))::bigint as tokens, (count(*) > 2 or sum(floor(value)) > 150) as over from events group by 1")
def requests_per_minute(spark, d):
    log = t(spark, d, "events").select("ts", F.floor("value").alias("tokens"))
    return ingest.per_minute(log, 2, 150)


@query()
def incremental_ingest(spark, d):
    """Documents in two batches; the graph's nodes after both."""
    import uuid

    G.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/ingest-{uuid.uuid4().hex}"
    store = ingest.Store(spark, folder)
    docs = t(spark, d, "documents").select(F.lit("text").alias("type"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))
    ingest.ingest_batch(store, docs.filter("ord % 2 = 0"), 0)
    ingest.ingest_batch(store, docs, 1)
    nodes, _ = store.graph()
    return nodes.select("node_id", "entity_type", F.size("source_ids").alias("sources"))
