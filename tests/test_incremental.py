"""Keyed streaming state and long mention tables."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from sparkweave import graph as G
from sparkweave.operators import extract, mentions, partition
from sparkweave.streaming import state

ENTITY, RELATION = "entity_name string, entity_type string, description string, source_id string", "src_id string, tgt_id string, description string, source_id string"


def test_graph_tables_against_merged_rows(spark):
    rng = random.Random(1)
    e = [(rng.choice("ABCDE"), rng.choice(["X", "Y", "Z"]), rng.choice(["d1", "d2", None]), f"c{rng.randrange(9)}") for _ in range(80)] + [("HOT", "X", f"t{k % 3}", f"c{k}") for k in range(300)]
    r = [(rng.choice("ABCUV"), rng.choice("ABCUV"), rng.choice(["r1", "r2"]), f"c{rng.randrange(9)}") for _ in range(60)]
    r = [x for x in r if x[0] != x[1]]
    entities, relations = spark.createDataFrame(e, ENTITY), spark.createDataFrame(r, RELATION)
    x = mentions.graph_tables(entities, relations)
    old = extract.merge_edges(relations)
    want = {n["node_id"]: n for n in extract.with_endpoints(extract.merge_nodes(entities), old).collect()}
    got = {n["node_id"]: n for n in x.nodes.select("node_id", "entity_type", "mentions", "sources", F.hll_sketch_estimate("source_sketch").alias("about")).collect()}
    assert set(got) == set(want) and {"U", "V"} <= set(got)
    for k, n in got.items():
        assert (n["entity_type"], n["sources"]) == (want[k]["entity_type"], len(want[k]["source_ids"]))
        assert abs(n["about"] - n["sources"]) <= 0.1 * n["sources"] + 1
        assert n["mentions"] == sum(m[0] == k for m in e)
    texts = {k["node_id"]: k["description"].split("<SEP>") for k in mentions.gathered(x.node_texts, ["node_id"], "description").collect()}
    assert texts == {k: n["descriptions"] for k, n in want.items() if n["descriptions"]}
    assert mentions.gathered(x.node_sources, ["node_id"], "source_id", most=2).filter("node_id = 'HOT'").first()[1] == "c0<SEP>c1"
    assert {(k["src"], k["tgt"]): k["sources"] for k in x.edges.collect()} == {(k["src"], k["tgt"]): len(k["source_ids"]) for k in old.collect()}
    half = [mentions.graph_tables(spark.createDataFrame(part, ENTITY), relations.limit(0)) for part in (e[::2], e[1::2])]
    both = mentions.merged_nodes(half[0].nodes, half[1].nodes, half[0].node_types.unionByName(half[1].node_types)).collect()
    for n in both:
        assert (n["entity_type"], n["mentions"]) == (got[n["node_id"]]["entity_type"], got[n["node_id"]]["mentions"]) and abs(n["sources"] - got[n["node_id"]]["sources"]) <= 0.1 * n["sources"] + 1
    empty = mentions.graph_tables(entities.limit(0), relations.limit(0))
    assert empty.nodes.count() == empty.edges.count() == 0


def test_adjacency_pages(spark):
    edges = spark.createDataFrame([("hub", f"n{k}") for k in range(1000)] + [("n1", "n2"), ("n2", "n1"), (None, "x")], "src string, tgt string")
    rows = mentions.adjacency_pages(edges, page=100).collect()
    hub = [r for r in rows if r["node_id"] == "hub"]
    assert len(hub) == 10 and max(len(r["neighbours"]) for r in hub) < 200 and sorted(v for r in hub for v in r["neighbours"]) == sorted(f"n{k}" for k in range(1000))
    assert [r["neighbours"] for r in rows if r["node_id"] == "n1"] == [["hub", "n2"]]


def read_bytes(spark, action):
    """Input bytes of the tasks that action() runs."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalInputBytes()
    before = total()
    action()
    return total() - before


def test_a_batch_reads_its_own_keys_only(spark, tmp_path):
    state.state_conf(spark)
    try:
        rng = random.Random(8)
        words = [f"Word{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(40)]
        words = [w[0] + w[1:].lower() for w in words]
        texts = [" ".join(rng.sample(words, 6)) for _ in range(120)]
        folder, store = tmp_path / "in", state.GraphStore(spark, str(tmp_path / "graph"))
        folder.mkdir()
        stream = spark.readStream.schema("content string").parquet(str(folder))

        def add(rows):
            spark.createDataFrame([(t,) for t in rows], "content string").coalesce(1).write.mode("append").parquet(str(folder))

        sizes = []
        batches = [texts[:20], texts[10:30] + [" " + texts[0], "", None], texts[30:50], texts[50:70], texts[70:90] + texts[:5]]
        for rows in batches:
            add(rows)
            sizes.append(read_bytes(spark, lambda: state.run(stream, store, str(tmp_path / "cp"))))
        seen = {t.strip() for rows in batches for t in rows if t and t.strip()}
        votes, sources = Counter(), {}
        for t in seen:
            for w in {w.upper() for w in t.split()}:
                votes[w] += 1
        assert {r["node_id"]: r["mentions"] for r in store.nodes().collect()} == votes
        assert Counter(r["node_id"] for r in store.read("node_sources").collect()) == votes
        pairs = Counter(p for t in seen for p in {tuple(sorted((a.upper(), b.upper()))) for a, b in zip(t.split(), t.split()[1:])})
        assert {(r["src"], r["tgt"]): r["mentions"] for r in store.edges().collect()} == pairs
        print("bytes read by batch", sizes)
        # what a batch reads does not grow with what is stored
        assert sizes[4] < 1.5 * max(sizes[1:3]) and os.path.isdir(tmp_path / "graph" / "votes" / "batch=4")
        store.compacted(str(tmp_path / "compact"))
        again = state.GraphStore(spark, str(tmp_path / "compact"))
        assert {r["node_id"]: r["mentions"] for r in again.nodes().collect()} == votes and again.read("votes").count() == len(votes)
        # nothing new: nothing changes
        state.run(stream, store, str(tmp_path / "cp"))
        assert {r["node_id"]: r["mentions"] for r in store.nodes().collect()} == votes
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")


def test_a_walk_steps_back(spark):
    """A comb: from the end of the spine the walk enters a tooth, meets its end, steps back and goes on."""
    spine = [(f"s{k}", f"s{k + 1}") for k in range(5)]
    teeth = [(f"s{k}", f"t{k}") for k in range(6)]
    nodes = spark.createDataFrame([(f"{c}{k}",) for c in "st" for k in range(6)], "node_id string")
    edges = spark.createDataFrame(spine + teeth, "src string, tgt string")
    units, links = partition.units_of(nodes, edges), partition.incidence(edges)
    # ranks rise with the distance from s0, so one walk begins; a tooth comes before the spine
    way = {f"s{k}": 2.0 * k for k in range(6)} | {f"t{k}": 2 * k + 1.5 for k in range(6)} | {f"s{k}\x01s{k + 1}": 2.0 * k + 1 for k in range(5)} | {f"s{k}\x01t{k}": 2 * k + 0.5 for k in range(6)}
    rank = spark.createDataFrame(list(way.items()), "unit_id string, k double").select("unit_id", F.struct("k", F.lit(0).cast("long").alias("h")).alias("rank"))
    got = partition.walk(units.join(rank, "unit_id"), links, 100).collect()
    order = [r["unit_id"] for r in sorted(got, key=lambda r: r["ord"]) if r["kind"] == "node"]
    assert len(got) == 12 + 11 and order == [f"{c}{k}" for k in range(6) for c in "st"]
    by = {}
    for r in got:
        by.setdefault(r["community_id"], []).append((r["ord"], r["unit_id"]))
    near = {(r["u"], r["v"]) for r in links.collect()}
    for c in by.values():
        c.sort()
        for k in range(1, len(c)):
            assert any((c[k][1], u) in near for _, u in c[:k])
    small = partition.dfs_communities(nodes, edges, 4, seed=3).collect()
    sizes = Counter(r["community_id"] for r in small)
    assert len(small) == 23 and max(sizes.values()) <= 4 and len({r["unit_id"] for r in small}) == 23


def test_keyword_passes_agree(spark):
    from sparkweave.operators import taxonomy

    nodes = spark.createDataFrame([(k, f"alpha beta{k} gamma" if k % 2 else None) for k in range(30)], "node_id long, hay string")
    kw = spark.createDataFrame([("alpha",), ("a",), ("beta1",), ("mma",), ("zzz",), ("",), ("beta1",)], "kw string")
    want = {(k, w) for k in range(1, 30, 2) for w in ("alpha", "a", "beta1", "mma") if w in f"alpha beta{k} gamma"}
    for size in (1 << 20, 3):
        got = taxonomy.keyword_hits(nodes, "node_id", "hay", kw, size).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert taxonomy.keyword_hits(nodes, "node_id", "hay", kw.limit(0)).count() == 0


def test_responses_are_made_and_parsed_once(spark):
    """All tables of a graph read mentions that are written; a table that is not asked for is not made."""

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def respond(k):
        made.add(1)
        return f'("entity"<|>a{k % 3}<|>t<|>x &amp; y)##("relationship"<|>a{k % 3}<|>b<|>near)<|COMPLETE|>'

    responses = spark.range(20).select(F.col("id").alias("chunk_id"), respond("id").alias("response"))
    x = mentions.graph_tables(*extract.mentions(responses))
    assert {tuple(r) for r in x.nodes.select("node_id", "mentions", "sources").collect()} == {("A0", 7, 7), ("A1", 7, 7), ("A2", 6, 6), ("B", 0, 20)}
    assert x.edges.count() == 3 and {r["description"] for r in x.node_texts.collect()} == {"x & y", "near"}
    assert made.value == 20
