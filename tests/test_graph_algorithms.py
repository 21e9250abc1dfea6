"""Graph algorithms against plain Python on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweave import graph as G
from sparkweave.operators import leiden, partition


def table(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, tgt string")


def modularity(edges, c):
    m, k = len(edges), {}
    for a, b in edges:
        k[c[a]] = k.get(c[a], 0) + 1
        k[c[b]] = k.get(c[b], 0) + 1
    return sum(c[a] == c[b] for a, b in edges) / m - sum((x / (2 * m)) ** 2 for x in k.values())


def louvain(edges, seed):
    """The textbook method: move single nodes until nothing gains, contract, repeat."""
    rng, w = random.Random(seed), {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            w.setdefault(x, {})[y] = w.setdefault(x, {}).get(y, 0) + 1
    total = sum(sum(x.values()) for x in w.values())
    member = {v: v for v in w}
    while True:
        k = {v: sum(w[v].values()) for v in w}
        c, size, moved, again = {v: v for v in w}, dict(k), False, True
        while again:
            again = False
            for v in rng.sample(sorted(w), len(w)):
                size[c[v]] -= k[v]
                to = {c[v]: 0}
                for u, x in w[v].items():
                    if u != v:
                        to[c[u]] = to.get(c[u], 0) + x
                best = max(to, key=lambda x: (to[x] - k[v] * size[x] / total, x == c[v]))
                again = again or best != c[v]
                c[v] = best
                size[best] += k[v]
            moved = moved or again
        if not moved:
            return member
        member = {v: c[x] for v, x in member.items()}
        new = {}
        for a in w:
            for b, x in w[a].items():
                row = new.setdefault(c[a], {})
                row[c[b]] = row.get(c[b], 0) + x
        w = new


def hangs_together(nodes, edges):
    seen, todo = set(), [next(iter(nodes))]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [b if a == v else a for a, b in edges if v in (a, b) and {a, b} <= nodes]
    return seen == nodes


def sample_graphs():
    rng = random.Random(7)
    ring = {(6 * q + j, 6 * q + i) for q in range(8) for i in range(6) for j in range(i)} | {tuple(sorted((6 * q, (6 * q + 7) % 48))) for q in range(8)}
    blocks = {(j, i) for i in range(60) for j in range(i) if rng.random() < (0.4 if i // 15 == j // 15 else 0.04)}
    ends, tree = [0, 1], {(0, 1)}
    for i in range(2, 45):
        for _ in range(2):
            j = rng.choice(ends)
            tree.add((j, i))
            ends += [i, j]
    return {"ring": ring, "blocks": blocks, "hubs": {(a, b) for a, b in tree if a != b}}


@pytest.mark.parametrize("name", ["ring", "blocks", "hubs"])
def test_leiden_is_as_good_as_louvain(spark, name):
    edges = sorted((f"{a:03}", f"{b:03}") for a, b in sample_graphs()[name])
    got = {r["node_id"]: r["community_id"] for r in leiden.leiden(table(spark, edges), tolerance=1e-6 if name == "hubs" else 1e-3).collect()}
    assert set(got) == {v for e in edges for v in e}
    assert modularity(edges, got) >= modularity(edges, louvain(edges, 0)) - 1e-9
    for c in set(got.values()):
        nodes = {v for v in got if got[v] == c}
        assert min(nodes) == c and hangs_together(nodes, edges)


def test_leiden_weights_and_odd_edges(spark):
    edges = [("a", "b", 9.0), ("b", "a", 9.0), ("c", "d", 9.0), ("b", "c", 1.0), ("d", "a", 1.0), ("a", "a", 5.0), ("e", "e", 1.0), ("c", "a", 0.0)]
    x = spark.createDataFrame(edges, "src string, tgt string, weight double")
    got = {r["node_id"]: r["community_id"] for r in leiden.leiden(x, "weight").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert leiden.leiden(x.limit(0)).count() == 0
    sliced = partition.modularity_communities(None, table(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")]), max_size=2, use_lcc=True).collect()
    assert sorted(tuple(r) for r in sliced) == [("a#0", "a"), ("a#0", "b"), ("a#1", "c")]


def tarjan(edges):
    """{node: smallest node of its strongly connected component} of nodes on a cycle, by plain search."""
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    reach = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), list(to.get(v, ()))
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += to.get(u, ())
        reach[v] = seen
    return {v: min(u for u in reach[v] if v in reach[u]) for v in reach if v in reach[v]}


def test_strong_components(spark):
    rng = random.Random(11)
    ring = [(f"a{k:03}", f"a{(k + 1) % 30:03}") for k in range(30)]
    parts = [
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("x", "x"), ("h", "a")],  # two cycles and an edge between
        ring + [("a000", "z"), ("z", "y")],
        [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(50)],
        [(str(k), str(k + 1)) for k in range(12)],
    ]
    edges = [(f"{k}:{a}", f"{k}:{b}") for k, part in enumerate(parts) for a, b in part]
    want = tarjan(edges)
    assert {r["node"]: r["component"] for r in G.strong_components(table(spark, edges)).collect()} == want
    on = {(a, b) for a, b in edges if a in want and want[a] == want.get(b)}
    assert {(r["src"], r["tgt"]) for r in G.cycle_core(table(spark, edges)).collect()} == on
    free = G.without_cycles(table(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])).collect()
    assert {(r["src"], r["tgt"]) for r in free} == {("a", "b"), ("b", "c"), ("c", "d")}


def test_pair_distances(spark):
    rng = random.Random(2)
    edges = [(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(110)] + [("h", str(k)) for k in range(5)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def distance(a, b):
        seen, ring, d = {a}, {a}, 0
        while ring:
            if b in ring:
                return d
            ring = {x for v in ring for x in near.get(v, ())} - seen
            seen |= ring
            d += 1

    pairs = [(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(60)] + [("h", "79"), ("nowhere", "1"), ("3", "3"), (None, "1")]
    got = G.pair_distances(table(spark, edges), spark.createDataFrame(pairs, "source string, target string"), 4)
    want = {(a, b): d for a, b in pairs if a is not None and (d := distance(a, b)) is not None and d <= 4}
    assert {(r["source"], r["target"]): r["hops"] for r in got.collect()} == want and got.count() == len(want)


def test_triangles_of_a_star_and_a_clique(spark):
    from sparkweave.operators import evaluation

    star = [("hub", f"leaf{k}") for k in range(3000)]
    clique = [(f"c{j:02}", f"c{i:02}") for i in range(40) for j in range(i)]
    edges = table(spark, star + clique + [("c00", "hub"), ("c01", "hub")])
    for cell in (512, 7):
        tri = evaluation.triangles(edges, cell)
        got = {frozenset(r) for r in tri.collect()}
        assert tri.count() == len(got) == 40 * 39 * 38 // 6 + 1 and frozenset(["hub", "c00", "c01"]) in got


def test_mtld_equals_plain_python(spark):
    import time

    from pyspark.sql import functions as F

    from sparkweave.operators import evaluation

    def factors(tokens, threshold=0.72):
        f = n = 0
        seen = set()
        for t in tokens:
            n += 1
            seen.add(t)
            if len(seen) / n <= threshold:
                f, n, seen = f + 1, 0, set()
        if n:
            f += 1 - (len(seen) / n - threshold) / (1 - threshold)
        return len(tokens) / f if f else float(len(tokens))

    rng = random.Random(9)
    texts = [[], ["a"], ["a", "a"], list("abcdefg"), [rng.choice("abcdefghij") for _ in range(300)], [f"w{int(rng.paretovariate(0.6))}" for _ in range(2000)]]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>").select("k", evaluation.mtld(F.col("t")).alias("m")).collect()
    for r in got:
        t = texts[r["k"]]
        assert r["m"] == pytest.approx((factors(t) + factors(t[::-1])) / 2 if t else 0.0)
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: (i.cast("long") * i % 4099).cast("string")).alias("t")).select(evaluation.mtld(F.col("t")).alias("m"))
    long.collect()
    began = time.time()
    long.collect()
    assert time.time() - began < 3  # a second on a free machine; quadratic time would be minutes


def test_a_pair_is_looked_up_from_its_smaller_ring(spark):
    pairs = spark.createDataFrame([(f"c{k}", "hub") for k in range(300)], "source string, target string")
    one = spark.createDataFrame([(f"c{k}", f"c{k}") for k in range(300)], "end string, node string")
    hub = spark.createDataFrame([("hub", f"c{k}") for k in range(300)], "end string, node string")
    for sources, targets, turned in ((one, hub, pairs), (hub, one, pairs.select(F.col("target").alias("source"), F.col("source").alias("target")))):
        assert sum(x.count() for _, _, x in G._by_smaller_ring(turned, sources, targets)) == 300  # not 300 nodes a pair


def test_pairs_of_two_components_grow_no_rings(spark, monkeypatch):
    edges = [(f"{side}{k}", f"{side}h") for side in "ab" for k in range(50)]
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(50)] + [("a0", "a1")], "source string, target string")
    found, listed = G._by_smaller_ring, []
    monkeypatch.setattr(G, "_by_smaller_ring", lambda p, *rings: (listed.append(p.count()), found(p, *rings))[1])
    assert [tuple(r) for r in G.pair_distances(table(spark, edges), pairs, 4).collect()] == [("a0", "a1", 2)]
    assert max(listed) == 1


def plain_distances(edges, pairs, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for a, b in pairs:
        ring = seen = {a}
        for hops in range(most + 1):
            if b in ring:
                want[a, b] = hops
                break
            ring = {x for v in ring for x in near.get(v, ())} - seen
            seen = seen | ring
    return want


def test_rings_of_distances_stay_in_proportion_to_the_edges(spark, monkeypatch):
    rng = random.Random(5)
    two = [(f"P{rng.randrange(300)}", f"S{rng.randrange(40)}") for _ in range(600)]  # a part and a supplier
    one = [(str(rng.randrange(90)), str(rng.randrange(90))) for _ in range(150)]
    found, listed = G._by_smaller_ring, []
    monkeypatch.setattr(G, "_by_smaller_ring", lambda p, *rings: (listed.extend(r.count() for r in rings), found(p, *rings))[1])
    monkeypatch.setattr(G, "ROOM", 1, raising=False)
    for edges, pairs in (
        (two, [(f"S{k}", f"S{k * 3 % 40}") for k in range(40)] + [(f"S{k % 40}", f"P{k}") for k in range(60)] + [(f"P{k}", f"S{k}") for k in range(5)] + [("P1", "P2"), ("S1", "nowhere")]),
        (one, [(str(rng.randrange(90)), str(rng.randrange(90))) for _ in range(60)]),
    ):
        listed.clear()
        got = [tuple(r) for r in G.pair_distances(table(spark, edges), spark.createDataFrame(pairs, "source string, target string"), 4).collect()]
        assert sorted(got) == sorted((*p, n) for p, n in plain_distances(edges, set(pairs), 4).items())
        assert max(listed) <= (1.3 if edges is two else 2.6) * len(set(edges))  # slices by hash are not quite even


def test_distances_in_little_room_equal_a_search(spark):
    rng = random.Random(6)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(75)] + [("long0", "0")] + [(f"long{k}", f"long{k + 1}") for k in range(5)]
    pairs = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(20)] + [("long5", "0"), ("long4", "0"), ("long5", "long0")]
    got = [tuple(r) for r in G.pair_distances(table(spark, edges), spark.createDataFrame(pairs, "source string, target string"), 5, room=40).collect()]
    assert sorted(got) == sorted((*p, n) for p, n in plain_distances(edges, set(pairs), 5).items())


def test_distances_leave_no_tables_of_edges(spark):
    from pathlib import Path

    G.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.iterdir())
    edges = [(f"P{k}", f"S{k % 50}") for k in range(500)] + [("P0", "S1"), ("P1", "S2")]
    got = G.pair_distances(table(spark, edges), spark.createDataFrame([("S0", "S2"), ("S0", "S9"), ("S3", "P3")], "source string, target string"), 4)
    left = [spark.read.parquet(str(x)).count() for x in set(folder.iterdir()) - before if any(x.glob("*.parquet"))]
    assert sorted(map(tuple, got.collect())) == [("S0", "S2", 4), ("S3", "P3", 1)]
    assert max(left) <= 3  # wanted pairs and pairs found, nothing of 500 edges


def test_cycles_of_single_ways_are_followed(spark):
    edges = [(f"c{k}", f"c{(k + 1) % 30}") for k in range(30)] + [(f"t{k:04}", f"t{k + 1:04}") for k in range(400)] + [("t0400", "c3"), ("x", "y"), ("y", "x"), ("y", "c0"), ("w", "y"), ("dead", "end")]
    cycles, left = G._followed(table(spark, edges))
    assert {tuple(r) for r in cycles.collect()} == {(f"c{k}", "c0") for k in range(30)}
    assert {tuple(r) for r in left.collect()} == {("x", "y"), ("y", "x"), ("w", "y")}
    got = {tuple(r) for r in G.strong_components(table(spark, edges)).collect()}
    assert got == {(f"c{k}", "c0") for k in range(30)} | {("x", "x"), ("y", "x")}


def test_paths_of_two_list_no_wedges(spark, monkeypatch):
    from sparkweave.operators import evaluation

    def wedges(*_):
        raise AssertionError("wedges are listed")

    monkeypatch.setattr(evaluation, "triangles", wedges)
    rng = random.Random(4)
    clique = [(f"c{i}", f"c{j}") for i in range(6) for j in range(i)]
    edges = {tuple(sorted(e)) for e in clique + [("h", f"c{k}") for k in range(3)] + [(f"r{rng.randrange(12)}", f"q{rng.randrange(12)}") for _ in range(60)] + [("a", "b")]}
    near = {}
    for a, b in edges:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    assert {tuple(r) for r in evaluation.on_paths_of_two(table(spark, sorted(edges))).collect()} == {e for e in edges if near[e[0]] != near[e[1]]}


def test_only_intents_that_can_be_tried_are_linked(spark, monkeypatch):
    from sparkweave.operators import generate, taxonomy

    tree = spark.range(200).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("steel").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("recall").alias("cognitive_dimension"), F.lit(None).cast("string").alias("parent_id"))
    nodes = spark.createDataFrame([("n1", "steel"), ("n2", "steel")], "node_id string, description string")
    link, asked = taxonomy.link_intents, []
    monkeypatch.setattr(taxonomy, "link_intents", lambda x, *rest, **names: (asked.append(x.count()), link(x, *rest, **names))[1])
    respond = lambda x: x.withColumn("response", F.concat(F.lit("Question: Q "), F.md5("intent_id"), F.lit("\nAnswer: A")))
    review = lambda x: x.withColumn("response", F.lit('{"passed": true, "overall_score": 0.75}'))
    assert generate.intent_run(tree, nodes, table(spark, [("n1", "n2")]), respond, review, 4).count() == 4
    assert max(asked) == 12


def test_large_settled_tables_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    big = G.settled(spark.range(300_000).select("id", F.xxhash64("id").alias("x")))
    small = G.settled(spark.range(10).withColumn("x", F.lit(1)))
    assert "BroadcastHashJoin" not in plan(big.join(big.select(F.col("x").alias("id"), F.lit(1).alias("y")), "id"))
    assert "BroadcastHashJoin" in plan(big.select("id").join(F.broadcast(small), "id"))
    assert "BroadcastHashJoin" in plan(small.join(small.select(F.col("x").alias("id"), F.lit(1).alias("y")), "id"))


def test_path_lengths_write_each_row_once(spark, monkeypatch):
    written, settled = [], G.settled

    def counted(df):
        out = settled(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "settled", counted)
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(8)] + [("c3", "c3"), ("c4", "c3"), ("n0", "n1")]
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in ("n0", "n1", "c0", "c4", "x"):
        ring, hops = {s}, {s: 0}
        for k in range(1, 6):
            ring = {v for u in ring for v in near.get(u, ())} - hops.keys()
            hops |= dict.fromkeys(ring, k)
        want |= {(s, v): k for v, k in hops.items()}
    sources = spark.createDataFrame([(x,) for x in ("n0", "n1", "c0", "c4", "x", "n0")], "node_id string")
    got = G.path_lengths(spark.createDataFrame(pairs, "src string, tgt string"), sources, 5).collect()
    assert len(got) == len(want) and {(r["source"], r["node_id"]): r["hops"] for r in got} == want
    assert sum(written) == len(want)
