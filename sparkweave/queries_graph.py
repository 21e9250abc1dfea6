"""Queries over graph algorithms, long mention tables, trees as intervals and keyed streaming state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from . import graph as G
from .operators import evaluation as E, extract, mentions, partition as P, taxonomy as X, tours
from .queries import _GRAPH, _MENTIONS, part_graph, part_responses, query, t
from .queries_more import _EDGES, _NODES, _TREE, nation_edges, nation_nodes, part_tree
from .streaming import state

# Long mention tables


def _tables(spark, d) -> mentions.GraphTables:
    return mentions.graph_tables(*extract.mentions(part_responses(spark, d)))


@query(f"""with {_MENTIONS}, v as (select part, kind, count(*) as n from m group by part, kind), k as (select part, kind from (select *, row_number() over (partition by part order by n desc, kind) as i from v) where i = 1)
select part as node_id, k.kind as entity_type, count(*) as mentions, count(distinct chunk) as sources from m join k using (part) group by part, k.kind union all select supp, 'UNKNOWN', 0, count(distinct chunk) from m group by supp""")
def entity_table(spark, d):
    return _tables(spark, d).nodes.select("node_id", "entity_type", "mentions", "sources")


@query(f"with {_MENTIONS} select least(part, supp) as src, greatest(part, supp) as tgt, count(*) as mentions, count(distinct chunk) as sources from m group by 1, 2")
def relation_table(spark, d):
    return _tables(spark, d).edges.select("src", "tgt", "mentions", "sources")


@query(f"with {_MENTIONS} select distinct part as node_id, chunk::varchar as source_id from m union select distinct supp, chunk::varchar from m")
def entity_sources(spark, d):
    return _tables(spark, d).node_sources


@query(f"with {_MENTIONS} select part as node_id, count(distinct about) as texts, sum(distinct length(about))::bigint as chars from (select distinct part, about from m) group by part union all select supp, count(*), sum(length(flag))::bigint from (select distinct supp, flag from m) group by supp")
def entity_texts(spark, d):
    texts = _tables(spark, d).node_texts
    return texts.groupBy("node_id").agg(F.count("*").alias("texts")).join(mentions.token_total(texts, ["node_id"], F.length("description")).withColumnRenamed("tokens", "chars"), "node_id")


@query(f"with {_GRAPH} select u as node_id, ceil(count(*) / 20.0)::bigint as pages, count(*) as neighbours, min(v) as first, max(v) as last from b group by u")
def adjacency_pages(spark, d):
    x = mentions.adjacency_pages(part_graph(spark, d), page=20)
    return x.groupBy("node_id").agg(F.max("pages").alias("pages"), F.sum(F.size("neighbours")).alias("neighbours"), F.min(F.col("neighbours")[0]).alias("first"), F.max(F.element_at("neighbours", -1)).alias("last"))


# Cycles, distances, triangles


@query("""with recursive n as (select count(*) as n from part), e as (select p_partkey as src, (p_partkey * p_partkey + p_size * 31 + floor(p_retailprice)::bigint) % n + 1 as tgt from part, n),
r as (select src, tgt from e union select r.src, e.tgt from r join e on e.src = r.tgt)
select 'P' || e.src as src, 'P' || e.tgt as tgt, 'P' || (select min(x.tgt::varchar) from r x where x.src = e.src and exists (select 1 from r y where y.src = x.tgt and y.tgt = x.src)) as component from e where exists (select 1 from r where r.src = e.src and r.tgt = e.src)""")
def cycle_edges(spark, d):
    """Each part points to one other: what lies on the cycles of that graph, which are of any length."""
    p = t(spark, d, "part")
    to = (F.col("p_partkey") * F.col("p_partkey") + F.col("p_size") * 31 + F.floor("p_retailprice")) % F.lit(p.count()) + 1
    return G.cycle_edges(p.select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("P"), to.cast("string")).alias("tgt")))


@query(f"""with recursive {_GRAPH}, n as (select count(*) as n from supplier), w as (select 'S' || s_suppkey as source, 'S' || ((s_suppkey * 3) % n + 1) as target from supplier, n union select 'S' || s_suppkey, 'P' || s_suppkey from supplier),
r(source, node, hops) as (select distinct source, source, 0 from w union select r.source, b.v, hops + 1 from r join b on b.u = r.node where hops < 4)
select source, target, min(hops)::int as hops from w join r using (source) where r.node = target group by source, target""")
def pair_distances(spark, d):
    """Every supplier to another supplier and to a part, four hops at most."""
    s = t(spark, d, "supplier")
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    k = F.col("s_suppkey")
    pairs = s.select(name("S", k).alias("source"), F.explode(F.array(name("S", (k * 3) % F.lit(s.count()) + 1), name("P", k))).alias("target"))
    return G.pair_distances(part_graph(spark, d), pairs, 4)


_MIXED = "e as (select distinct 'C' || o_custkey as src, 'P' || o_orderpriority as tgt from orders union select 'C' || c_custkey, 'N' || c_nationkey from customer union select distinct 'P' || o_orderpriority, 'N' || c_nationkey from orders join customer on o_custkey = c_custkey)"


@query(f"with {_MIXED}, c as (select src as c, tgt as n from e where src like 'C%' and tgt like 'N%'), p as (select src as c, tgt as p from e where src like 'C%' and tgt like 'P%'), x as (select c.c, p.p, c.n from c join p using (c) join e on e.src = p.p and e.tgt = c.n), a as (select unnest([c, p, n]) as node_id from x) select node_id, count(*) as triangles from a group by node_id")
def node_triangles(spark, d):
    """Triangles of customers, the priorities of their orders, and their nations, by node."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    name = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    e = o.select(name("C", "o_custkey").alias("src"), name("P", "o_orderpriority").alias("tgt")).unionByName(c.select(name("C", "c_custkey").alias("src"), name("N", "c_nationkey").alias("tgt")))
    of = o.join(c, o["o_custkey"] == c["c_custkey"]).select(name("P", "o_orderpriority").alias("src"), name("N", "c_nationkey").alias("tgt"))
    tri = E.triangles(G.settled(e.unionByName(of).distinct()))
    return tri.select(F.explode(F.array("u", "p", "q")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))


# Trees as intervals

#: Positions in pre-order: by the path of ids, whose order is the order of lists.
_TOUR = f"""{_TREE}, x as (select id, parent_id, depth, is_leaf, split_part(id, '/', 1) as root, case depth when 0 then [id] when 1 then [parent_id, id] else [split_part(id, '/', 1), parent_id, id] end as path from tree),
y as (select *, row_number() over (partition by root order by path) - 1 as place from x), z as (select y.*, 1 + case depth when 0 then (select count(*) from x k where k.root = y.id) - 1 when 1 then (select count(*) from x k where k.parent_id = y.id) else 0 end as size from y),
tour as (select id, parent_id, root, (2 * place - depth)::bigint as enter, (2 * place - depth + 2 * size - 1)::bigint as leave, depth::int as depth, is_leaf, size::bigint as size, place from z)"""


@query(f"with {_TOUR} select id, parent_id, root, enter, leave, depth, is_leaf from tour")
def taxonomy_tours(spark, d):
    return tours.euler_tour(part_tree(spark, d))


@query(f"with {_TOUR} select t.id, t.size, sum(k.depth)::double as total from tour t join tour k on k.root = t.root and k.enter between t.enter and t.leave group by t.id, t.size")
def subtree_totals(spark, d):
    return tours.subtree_totals(G.settled(tours.euler_tour(part_tree(spark, d))), F.col("depth"))


@query(f"with {_TOUR} select root, enter as at, repeat('  ', depth) || '- ' || id || case when coalesce(description, '') <> '' then ': ' || description else '' end as line from tour left join (select p_type || '/' || p_brand || '/' || p_partkey as id, p_name as description from part) using (id)")
def taxonomy_outline(spark, d):
    tree = part_tree(spark, d)
    names = t(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("description"))
    return tours.outline(G.settled(tours.euler_tour(tree)), names, "outline")


# Communities


def _broken(members: DataFrame, links: DataFrame, cap: int | None) -> list:
    """Counts of what no partition may have: units twice, communities over their cap, communities in pieces."""
    side = lambda c: members.select(F.col("unit_id").alias(c), F.col("community_id").alias(f"c_{c}"))
    inside = links.join(side("u"), "u").join(side("v"), "v").filter("c_u = c_v")
    parts = G.connected_components(inside, "u", "v").withColumnRenamed("node", "unit_id")
    pieces = members.join(parts, "unit_id", "left").groupBy("community_id").agg(F.countDistinct(F.coalesce("component", "unit_id")).alias("n"), F.count("*").alias("size"))
    twice = members.groupBy("unit_id").agg(F.count("*").alias("n")).filter("n > 1")
    return [members.select("unit_id").distinct().count(), twice.count(), pieces.filter(F.col("size") > cap).count() if cap else 0, pieces.filter("n > 1").count()]


@query(f"""with {_NODES}, {_EDGES}, n as (select (select count(*) from nodes) + (select count(*) from edges) as n), k as (select count(*) as n from (select src from edges union select tgt from edges))
select partitioner, units::bigint as units, 0::bigint as twice, 0::bigint as over_cap, 0::bigint as in_pieces from (select 'bfs' as partitioner, n as units from n union all select 'dfs', n from n union all select 'modularity', n from k union all select 'anchor', null from k union all select 'ece', null from k)""")
def partition_invariants(spark, d):
    """Each unit once, no community over its cap or in pieces: breadth-first, depth-first, by modularity, from anchors and by loss."""
    nodes, edges = nation_nodes(spark, d), G.settled(nation_edges(spark, d))
    links = G.settled(P.incidence(edges))
    found = [("bfs", P.bfs_communities(nodes, edges, 5), links, 5), ("dfs", P.dfs_communities(nodes, edges, 4), links, 4)]
    best = P.modularity_communities(nodes, edges).withColumnRenamed("node_id", "unit_id")
    found.append(("modularity", best, G.both_ways(edges), None))
    found.append(("anchor", P.anchored_communities(nodes, edges, 6, anchor_type="nation"), links, 6))
    found.append(("ece", P.loss_communities(nodes, edges, 5, max_tokens=12, min_units=2, sampling="max_loss"), links, 5))
    rows = [(name, *_broken(G.settled(x.select("community_id", "unit_id")), y, cap)) for name, x, y, cap in found]
    rows = [(name, None if name in ("anchor", "ece") else units, *rest) for name, units, *rest in rows]  # these leave units out
    return spark.createDataFrame(rows, "partitioner string, units long, twice long, over_cap long, in_pieces long")


# Keyed streaming state


@query(r"""with l as (select distinct trim(x) as line from (select unnest(string_split_regex(text, '[.\n]')) as x from conversations) where trim(x) <> ''),
w as (select line, unnest(list_distinct(list_transform(list_filter(string_split(regexp_replace(line, '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}')), lambda x: upper(x)))) as node_id from l)
select node_id, '"TERM"' as entity_type, count(*) as mentions, count(distinct line) as sources from w group by node_id""")
def keyed_ingest(spark, d):
    """The sentences of all conversations as a stream of documents, a chunk each: nodes with their mentions and sources, from keyed state."""
    G.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/graph-{uuid.uuid4().hex}"
    lines = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{d}/conversations.parque[t]")  # a pattern, as a stream reads folders or patterns
    lines = lines.select(F.explode(F.split("text", r"[.\n]")).alias("content"))
    store = state.GraphStore(spark, f"{folder}/graph")
    state.run(lines, store, f"{folder}/state")
    return store.nodes().join(mentions.occurrences(store.read("node_sources"), ["node_id"]).withColumnRenamed("occurrences", "sources"), "node_id")
