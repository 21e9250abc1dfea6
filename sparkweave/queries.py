"""Registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import graph as G
from .functions import text as T
from .operators import assess, chunking, extract
from .plans import build
from .sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    from . import queries_extra, queries_graph, queries_items, queries_more  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql():
    queries()
    return dict(_SQL)


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.top_entities(build.documents_of(t(spark, sf_dir, "documents")))


@query()
def top_entities(spark, d):
    return flagship(spark, d)


# Text functions

_ZH, _EN = "len(regexp_extract_all(text, '[一-鿿]'))", "len(regexp_extract_all(text, '[A-Za-z]'))"


@query(f"select doc_id, case when {_ZH} > 0 and {_ZH} >= {_EN} then 'zh' else 'en' end as language, regexp_matches(text, '[一-鿿]') as chinese from documents")
def detect_language(spark, d):
    return t(spark, d, "documents").select("doc_id", T.main_language("text").alias("language"), T.has_chinese("text").alias("chinese"))


@query("select min(doc_id) as doc_id, 'doc-' || md5(text) as hash, count(*) as copies from documents group by text")
def content_hash_dedup(spark, d):
    return t(spark, d, "documents").groupBy(T.content_hash("text", "doc-").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_COMPLEX = r"""case when text = '' then 0.5 else least(1.0, greatest(least(1.0, (length(text) - s + 1)::double / s / 200.0), len(regexp_extract_all(text, '[()\[\]{}<>$%^&*+=|\\/~`]'))::double / length(text) * 2)) end"""


@query(f"""select doc_id, round(c, 6) as complexity, greatest(256, least(4096, case when c > 0.8 then floor(b * 0.8) when c < 0.3 then floor(b * 1.2) else b end))::int as chunk_size
 from (select doc_id, {_COMPLEX} as c, case when length(text) > 100000 then 2048 when length(text) > 50000 then 1536 when length(text) < 10000 then 512 else 1024 end as b
 from (select *, length(text) - length(replace(text, '.', '')) + 1 as s from documents))""")
def dynamic_chunk_size(spark, d):
    x = t(spark, d, "documents").withColumn("c", T.complexity("text"))
    return x.select("doc_id", F.round("c", 6).alias("complexity"), T.chunk_size_for(F.length("text"), F.col("c")).alias("chunk_size"))


@query("select item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS if w.isascii()) + "], w)))) as keywords from benchmark")
def keyword_tokens(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.keywords("text").alias("keywords"))


@query(r"""select lang, count(*) as docs, sum(n)::bigint as tokens, (sum(n) * 50)::bigint as usage_estimate from (select lang,
 len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + list_sum(list_transform(regexp_extract_all(text || ' z', '[A-Za-z0-9]+'), lambda w: ceil(length(w) / 4.0)::bigint)) - 1
 + len(regexp_extract_all(text, '[^A-Za-z0-9\s\x{4e00}-\x{9fff}]')) as n from documents) group by lang""")
def token_usage(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.token_estimate("text")).alias("tokens"), (F.sum(T.token_estimate("text")) * 50).alias("usage_estimate"))


@query(r"""select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) as clean from documents""")
def cleaned_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.trim(T.clean("text")).alias("clean"))


@query("""with w as (select doc_id, regexp_extract_all(text, '[^ \\t-\\r]+') as ids from documents)
select doc_id, (i // 400)::int as win, len(ids[i + 1 : i + 512])::int as n, ids[i + 1] as head from w, unnest(range(0, len(ids), 400)) as u(i)""")
def token_window_chunks(spark, d):
    ids = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    step = F.sequence(F.lit(0), F.size("ids") - 1, F.lit(400))
    x = t(spark, d, "documents").withColumn("ids", ids).filter(F.size("ids") > 0)
    wins = F.transform(step, lambda i: F.slice("ids", i + 1, F.lit(512)))
    return x.select("doc_id", F.posexplode(wins).alias("win", "w")).select("doc_id", "win", F.size("w").alias("n"), F.element_at("w", 1).alias("head"))


# Chunking


@query()
def recursive_chunks(spark, d):
    docs = build.documents_of(t(spark, d, "documents"))
    return chunking.chunk_documents(docs).select("chunk_id", "full_doc_id", "length", "language")


@query()
def dynamic_chunks(spark, d):
    docs = build.documents_of(t(spark, d, "documents"))
    return chunking.chunk_documents(docs, dynamic=True).select("chunk_id", "full_doc_id", "length", "language")


@query()
def markdown_chunks(spark, d):
    return chunking.split_texts(t(spark, d, "pages"), "page_id", "html", "markdown", 1024)


@query("""with p as (select doc_id, string_split(text, chr(10)) as l from documents),
q as (select doc_id, x.pos - 1 as pos, x.line from (select doc_id, unnest(list_transform(l, lambda s, i: {'pos': i, 'line': s})) as x from p))
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as pos, trim(line, ' ') as content from q where trim(line, ' ') <> ''""")
def char_split_chunks(spark, d):
    """Size 1: every line that is not blank is a chunk of its own."""
    return chunking.split_on_character(t(spark, d, "documents"), "doc_id", "text", "\n", size=1)


@query("""with c as (select p_brand as table_id, p_partkey as "row", 1 as col, replace(p_name, '|', '\\|') as v from part union all select p_brand, p_partkey, 2, p_type from part)
, r as (select table_id, "row", '| ' || string_agg(v, ' | ' order by col) || ' |' as line from c group by table_id, "row")
, m as (select table_id, list(line order by "row") as l from r group by table_id)
select table_id, array_to_string(l[1:1] || ['| --- | --- |'] || l[2:], chr(10)) as markdown from m""")
def table_to_markdown(spark, d):
    p = t(spark, d, "part")
    cells = p.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row"), F.lit(1).alias("col"), F.col("p_name").alias("value"))
    cells = cells.unionByName(p.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row"), F.lit(2).alias("col"), F.col("p_type").alias("value")))
    return chunking.table_markdown(cells)


# Keyed tables


@query("select item_id as k, md5(text) as v, 'store' as origin from benchmark where item_id % 2 = 0 union all select doc_id, min(md5(text)), 'new' from documents where not (doc_id % 2 = 0 and doc_id in (select item_id from benchmark)) group by doc_id")
def insert_absent(spark, d):
    store = t(spark, d, "benchmark").filter("item_id % 2 = 0").select(F.col("item_id").alias("k"), F.md5("text").alias("v"), F.lit("store").alias("origin"))
    new = t(spark, d, "documents").select(F.col("doc_id").alias("k"), F.md5("text").alias("v"), F.lit("new").alias("origin"))
    return tables.insert_absent(store, new, "k", order="v")


@query("select role, text from conversations where turn = 0 union all select role, text from conversations c where turn > 0 and not exists (select 1 from conversations s where s.turn = 0 and s.role = c.role and s.text = c.text)")
def append_new_items(spark, d):
    c = t(spark, d, "conversations")
    return tables.append_new(c.filter("turn = 0").select("role", "text"), c.filter("turn > 0").select("role", "text"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def filter_keys(spark, d):
    return tables.missing_keys(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query("select (d.doc_id * 7 % 1000003)::bigint as pos, d.doc_id, l.quality, l.toxic from documents d left join (select doc_id, min(quality) as quality, min(toxic) as toxic from labels group by doc_id) l using (doc_id)")
def ordered_lookup(spark, d):
    ids = t(spark, d, "documents").select((F.col("doc_id") * 7 % 1000003).alias("pos"), "doc_id")
    store = t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    return tables.lookup(ids, store, "doc_id", ["quality", "toxic"])


@query("select s_suppkey, s_name, coalesce(case when s_acctbal < 0 then 0.0 end, s_acctbal) as s_acctbal, case when s_acctbal < 0 then 'debt' end as flag from supplier")
def graph_attribute_update(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = s.filter("s_acctbal < 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal"), F.lit("debt").alias("flag"))
    return tables.updated(s, changes, ["s_suppkey"])


# Extraction and merging: each order line is a chunk's record about a part and a supplier


def part_responses(spark, d):
    """(chunk_id, response): each order's lines as extraction records."""
    l = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    part, supp = F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    entity = F.concat(F.lit('("entity"<|>'), part, F.lit("<|>"), F.col("p_brand"), F.lit("<|>"), F.col("p_name"), F.lit(")"))
    relation = F.concat(F.lit('("relationship"<|>'), part, F.lit("<|>"), supp, F.lit("<|>"), F.col("l_returnflag"), F.lit(")"))
    x = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(entity, F.lit("##"), relation))).alias("r"))
    return x.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.array_join("r", "##"), F.lit("##<|COMPLETE|>")).alias("response"))


_MENTIONS = "m as (select l_orderkey as chunk, 'PART ' || l_partkey as part, 'SUPPLIER ' || l_suppkey as supp, upper(p_brand) as kind, p_name as about, l_returnflag as flag from lineitem join part on l_partkey = p_partkey)"


@query(f"with {_MENTIONS} select 'entity' as kind, part as a, kind as b, about as description, chunk as source_id from m union all select 'relationship', part, supp, flag, chunk from m")
def parse_extraction(spark, d):
    e, r = extract.mentions(part_responses(spark, d))
    e = e.select(F.lit("entity").alias("kind"), F.col("entity_name").alias("a"), F.col("entity_type").alias("b"), "description", "source_id")
    return e.unionByName(r.select(F.lit("relationship").alias("kind"), F.col("src_id").alias("a"), F.col("tgt_id").alias("b"), "description", "source_id"))


def _merged(spark, d):
    e, r = extract.mentions(part_responses(spark, d))
    return extract.merge_nodes(e), extract.merge_edges(r)


@query(f"""with {_MENTIONS}, v as (select part, kind, count(*) as n from m group by part, kind), k as (select part, kind from (select *, row_number() over (partition by part order by n desc, kind) as i from v) where i = 1)
select part as node_id, k.kind as entity_type, string_agg(distinct about, '<SEP>' order by about) as description, count(distinct chunk) as sources from m join k using (part) group by part, k.kind""")
def merge_nodes(spark, d):
    nodes, _ = _merged(spark, d)
    return nodes.select("node_id", "entity_type", F.array_join("descriptions", "<SEP>").alias("description"), F.size("source_ids").cast("long").alias("sources"))


@query(f"with {_MENTIONS} select least(part, supp) as src, greatest(part, supp) as tgt, string_agg(distinct flag, '<SEP>' order by flag) as description, count(distinct chunk) as sources from m group by 1, 2")
def merge_edges(spark, d):
    _, edges = _merged(spark, d)
    return edges.select("src", "tgt", F.array_join("descriptions", "<SEP>").alias("description"), F.size("source_ids").cast("long").alias("sources"))


@query(f"with {_MENTIONS} select supp as node_id, 'UNKNOWN' as entity_type, string_agg(distinct flag, '<SEP>' order by flag) as description, count(distinct chunk) as occurrences from m group by supp")
def backfill_endpoints(spark, d):
    nodes, edges = _merged(spark, d)
    x = extract.with_endpoints(nodes, edges).filter("entity_type = 'UNKNOWN'")
    return x.select("node_id", "entity_type", F.array_join("descriptions", "<SEP>").alias("description"), F.size("source_ids").cast("long").alias("occurrences"))


@query("""select doc_id, (count(*) over ())::bigint as total, case when md5(text) in (select md5(text) from documents where doc_id % 3 = 0) then 'cached' else 'pending' end as state from documents""")
def extraction_cache(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    cache = docs.filter("chunk_id % 3 = 0").select(F.md5("content").alias("content_hash"), F.lit("").alias("response")).dropDuplicates(["content_hash"])
    todo, hits = extract.pending(docs, cache)
    n = F.lit(docs.count()).cast("long")
    return todo.select(F.col("chunk_id").alias("doc_id"), n.alias("total"), F.lit("pending").alias("state")).unionByName(hits.select(F.col("chunk_id").alias("doc_id"), n.alias("total"), F.lit("cached").alias("state")))


@query(r"""select item_id, tokens, case when tokens < 60 then 'keep' else 'summarize' end as route, case when tokens >= 60 then substr(text, 1, 240) end as prompt_text from (select *,
 (len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: ceil(length(w) / 4.0)::bigint)), 0) + len(regexp_extract_all(text, '[^A-Za-z0-9\s\x{4e00}-\x{9fff}]')))::bigint as tokens from benchmark)""")
def summary_routing(spark, d):
    return extract.summary_routes(t(spark, d, "benchmark"), "text", limit=60).select("item_id", "tokens", "route", "prompt_text")


@query("""with r as (select conv_id, list(text order by turn) as parts from conversations where text <> '' group by conv_id)
select conv_id, i::int as part, case when i % 3 = 0 then array_to_string(list_transform(parts, lambda p, k: case when k % 3 = 0 then '' else '[Text ' || k || ']' || chr(10) || replace(p, '[', '(') || chr(10) end), '') else trim(replace(parts[i], '[', '('), chr(10)) end as section
from r, unnest(range(1, len(parts) + 1)) as u(i)""")
def split_merged_response(spark, d):
    """Each conversation as one merged response; every third section lacks its marker."""
    c = t(spark, d, "conversations").filter("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x, k: F.when((k + 1) % 3 == 0, "").otherwise(F.concat(F.lit("[Text "), (k + 1).cast("string"), F.lit("]\n"), F.replace(x["text"], F.lit("["), F.lit("(")), F.lit("\n")))), "")
    ids = F.transform("p", lambda x, k: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (k + 1).cast("string")))
    out = extract.split_response(c.select(F.col("conv_id").alias("group_id"), ids.alias("chunk_ids"), body.alias("response")))
    part = F.split("chunk_id", ":")
    section = F.when(part[1].cast("int") % 3 == 0, F.col("response")).otherwise(F.trim("response"))
    return out.select(part[0].cast("long").alias("conv_id"), part[1].cast("int").alias("part"), F.when(part[1].cast("int") % 3 == 0, section).otherwise(F.regexp_replace(F.col("response"), "^\n+|\n+$", "")).alias("section"))


@query("select c.conv_id, c.turn, 'Reference:' || chr(10) || f.text || chr(10) || 'Rewrite with every pronoun replaced by its referent:' || chr(10) || c.text as prompt from conversations c join (select conv_id, arg_min(text, turn) as text from conversations group by conv_id) f using (conv_id)")
def coreference_prompts(spark, d):
    c = t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("full_doc_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return extract.coreference_prompts(c).select("chunk_id.*", "prompt")


@query("""select s_name as entity, max(case when k = 0 then v end) as wikipedia, max(case when k = 1 then v end) as google, max(case when k = 2 then v end) as bing
from (select s_name, s_suppkey % 3 as k, n_name as v from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 5 <> 0) group by s_name""")
def search_enrichment(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = s.select(F.col("s_name").alias("node_id"))
    source = F.element_at(F.array(F.lit("wikipedia"), F.lit("google"), F.lit("bing")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    known = s.filter("s_suppkey % 5 = 0").select(F.col("s_name").alias("node_id"))
    return extract.enriched(nodes, s.select(F.col("s_name").alias("entity"), source.alias("source"), F.col("n_name").alias("description")), known)


# Graph


def part_graph(spark, d):
    """Edges between parts and suppliers that share an order line."""
    return t(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt")).distinct()


_GRAPH = "e as (select distinct 'P' || l_partkey as src, 'S' || l_suppkey as tgt from lineitem), b as (select src as u, tgt as v from e union all select tgt, src from e), g as (select u as node_id, count(*) as degree from b group by u)"


@query(f"with {_GRAPH} select * from g")
def node_degree(spark, d):
    return G.degrees(part_graph(spark, d))


@query(f"with {_GRAPH} select e.src, e.tgt, a.degree + z.degree as degree from e join g a on a.node_id = e.src join g z on z.node_id = e.tgt")
def edge_degree(spark, d):
    return G.edge_degrees(part_graph(spark, d))


@query(f"with {_GRAPH} select u as node_id, string_agg(distinct v, ',' order by v) as neighbours from b group by u")
def adjacency(spark, d):
    return G.adjacency(part_graph(spark, d)).select("node_id", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"with {_GRAPH} select (substr(src, 2)::bigint % 10)::bigint as community_id, src, tgt from e where substr(src, 2)::bigint % 10 = substr(tgt, 2)::bigint % 10")
def induced_edges(spark, d):
    e = part_graph(spark, d)
    m = G.degrees(e).select("node_id", (F.substring("node_id", 2, 20).cast("long") % 10).alias("community_id"))
    return G.induced_edges(e, m)


def nation_graph(spark, d):
    """Customers in nations with an even key in regions; others stand alone with their nation."""
    c = t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("tgt"))
    n = t(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("tgt"))
    return c.unionByName(n)


_COMPONENTS = """k as (select 'C' || c_custkey as node, case when c_nationkey % 2 = 0 then 'R' || n_regionkey else 'N' || c_nationkey end as part from customer join nation on c_nationkey = n_nationkey
union select 'N' || n_nationkey, case when n_nationkey % 2 = 0 then 'R' || n_regionkey else 'N' || n_nationkey end from nation where n_nationkey % 2 = 0 or n_nationkey in (select c_nationkey from customer)
union select 'R' || n_regionkey, 'R' || n_regionkey from nation where n_nationkey % 2 = 0), m as (select part, min(node) as component, count(*) as n from k group by part)"""


@query(f"with {_COMPONENTS} select node, component from k join m using (part)")
def connected_components(spark, d):
    return G.connected_components(nation_graph(spark, d))


@query(f"with {_COMPONENTS} select node as node_id from k join (select part from m order by n desc, component limit 1) using (part)")
def largest_component(spark, d):
    e = nation_graph(spark, d)
    nodes, _ = G.largest_component(G.degrees(e).select("node_id"), e)
    return nodes.select("node_id")


@query(f"""with {_GRAPH}, s as (select (substr(node_id, 2)::bigint % 3)::bigint as intent_id, node_id from g where node_id like 'S%' and substr(node_id, 2)::bigint % 10 = 0),
h1 as (select distinct intent_id, v as node_id from s join b on u = node_id), n1 as (select intent_id, node_id, min(hop)::int as hop from (select *, 0 as hop from s union all select *, 1 from h1) group by 1, 2)
select intent_id, node_id, hop from (select *, row_number() over (partition by intent_id order by hop, node_id) as r from n1) where r <= 40""")
def k_hop_subgraph(spark, d):
    e = part_graph(spark, d)
    seeds = G.degrees(e).filter("node_id like 'S%' and cast(substring(node_id, 2) as long) % 10 = 0").select((F.substring("node_id", 2, 20).cast("long") % 3).alias("intent_id"), "node_id")
    return G.k_hop(e, seeds, max_hops=1, max_nodes=40)[0]


@query(f"""with {_GRAPH}, n as (select node_id from g order by node_id limit 2050) select src, tgt from e where src in (select node_id from n) and tgt in (select node_id from n)""")
def fallback_subgraph(spark, d):
    e = part_graph(spark, d)
    return G.first_nodes(G.degrees(e).select("node_id"), e, 2050)[1]


@query(f"""with {_GRAPH}, s as (select node_id from g where node_id like 'S%' and substr(node_id, 2)::bigint % 10 = 0), h1 as (select distinct node_id as source, v as node_id from s join b on u = node_id),
h2 as (select distinct source, v as node_id from h1 join b on u = node_id), a as (select node_id as source, node_id, 0 as hops from s union all select *, 1 from h1 union all select *, 2 from h2)
select source, node_id, min(hops)::int as hops from a group by 1, 2""")
def path_lengths(spark, d):
    e = G.settled(part_graph(spark, d))
    return G.path_lengths(e, G.degrees(e).filter("node_id like 'S%' and cast(substring(node_id, 2) as long) % 10 = 0"), 2)


@query("with m as (select n_regionkey as r, min(n_nationkey) as n from nation group by 1) select 'N' || n as src, 'R' || r as tgt from m union all select 'R' || r, 'N' || n from m")
def hierarchy_cycles(spark, d):
    """Nations point to regions, and each region to its first nation: what lies on cycles."""
    n = t(spark, d, "nation")
    up = n.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("tgt"))
    down = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n").alias("tgt"))
    return G.cycle_core(up.unionByName(down))


# Comprehension


_UNITS = "u as (select d.doc_id as unit_id, case when l.quality = 1 then 'yes' else 'no' end as gt, case when d.doc_id % 11 = 0 then 'maybe' when d.doc_id % 7 = 0 then 'Yes' when d.doc_id % 2 = 0 then 'yes' else 'no' end as token, (1 + d.doc_id % 97) / 100.0::double as prob from documents d join labels l using (doc_id))"


def _judged(spark, d):
    i = F.col("doc_id")
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    token = F.when(i % 11 == 0, "maybe").when(i % 7 == 0, "Yes").when(i % 2 == 0, "yes").otherwise("no")
    return x.select(i.alias("unit_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("gt"), token.alias("token"), ((1 + i % 97) / F.lit(100.0)).alias("prob"))


@query(f"with {_UNITS} select unit_id, round(case when max(case when lower(token) in ('yes', 'no') then 0 else 1 end) = 1 then -ln(0.1::double) else avg(case when token = gt then -ln(prob) else -ln(1 - prob) end) end, 6) as loss from u group by unit_id")
def judge_loss(spark, d):
    return assess.losses(_judged(spark, d)).withColumn("loss", F.round("loss", 6))


@query(f"with {_UNITS} select unit_id, round(case when max(case when lower(token) in ('yes', 'no') then 0 else 1 end) = 1 then -ln(0.1::double) else avg(case when lower(token) = gt then 1 - prob else prob end) end, 6) as loss from u group by unit_id")
def linear_loss(spark, d):
    return assess.losses(_judged(spark, d), case_sensitive=False, entropy=False).withColumn("loss", F.round("loss", 6))


@query("""with p as (select vec_id, list_filter(list_transform(embedding, lambda x: abs(x)::double), lambda x: x > 0) as p from embeddings)
select vec_id, round(exp(list_avg(list_transform(p, lambda x: ln(x)))), 6) as joint, round(list_min(p), 6) as least, round(list_avg(p), 6) as mean from p""")
def token_confidence(spark, d):
    p = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    x = t(spark, d, "embeddings").withColumn("p", p)
    return x.select("vec_id", F.round(T.joint_probability("p"), 6).alias("joint"), F.round(T.min_probability("p"), 6).alias("least"), F.round(T.mean_probability("p"), 6).alias("mean"))


@query("""select description, gt, k::int as k from (select distinct text as description from benchmark) , (select 'yes' as gt, unnest([1, 2]) as k union all select 'no', unnest([1, 2, 3]))""")
def statement_prompts(spark, d):
    b = t(spark, d, "benchmark").select(F.col("text").alias("description"))
    return assess.statement_prompts(b, b, samples=3).select("description", "gt", "k")
