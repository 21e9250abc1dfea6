"""Trees as intervals against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from sparkweave import graph as G
from sparkweave.operators import tours

TREE = "id string, parent_id string, name string, cognitive_dimension string, description string"


def tree_table(spark, rows):
    return spark.createDataFrame([(i, p, f"n{i}", None, "about" if i[-1] in "135" else None) for i, p in rows], TREE)


def plain_tour(rows):
    """{id: (root, enter, leave, depth)} by a stack."""
    ids, kids = {i for i, _ in rows}, {}
    for i, p in rows:
        kids.setdefault(p if p in ids else None, []).append(i)
    out = {}
    for root in kids.get(None, []):
        clock, todo = 0, [(root, 0, False)]
        while todo:
            v, d, closing = todo.pop()
            if closing:
                out[v] = (root, out[v], clock, d)
            else:
                out[v] = clock
                todo.append((v, d, True))
                todo += [(c, d + 1, False) for c in sorted(kids.get(v, []), reverse=True)]
            clock += 1
    return {v: x for v, x in out.items() if isinstance(x, tuple)}


def test_tour_equals_a_stack(spark):
    rng = random.Random(3)
    rows = [("r0", None), ("r1", "gone"), ("r2", None)] + [(f"x{k:03}", rng.choice(["r0", "r1", *[f"x{j:03}" for j in range(k)]])) for k in range(150)]
    cyclic = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("self", "self")]
    tree = tree_table(spark, rows + cyclic)
    tour = tours.euler_tour(tree).cache()
    want = plain_tour(rows)
    assert {r["id"]: (r["root"], r["enter"], r["leave"], r["depth"]) for r in tour.collect()} == want
    assert {r["id"] for r in tour.filter("is_leaf").collect()} == {i for i, _ in rows} - {p for _, p in rows}
    parent = dict(rows)
    node, branch = max(want, key=lambda v: (want[v][3], v)), []
    v = node
    while v in want:
        branch.insert(0, v)
        v = parent[v]
    assert [r["id"] for r in tours.ancestors(tour, node).orderBy("position").collect()] == branch
    inside = {v for v in want if want[v][0] == want[branch[1]][0] and want[branch[1]][1] <= want[v][1] <= want[branch[1]][2]}
    assert {r["id"]: r["distance"] for r in tours.descendants(tour, branch[1]).collect()} == {v: want[v][3] - 1 for v in inside}
    sizes = {r["id"]: (r["size"], r["total"]) for r in tours.subtree_totals(tour, F.col("depth")).collect()}
    below = lambda v: [u for u in want if want[u][0] == want[v][0] and want[v][1] <= want[u][1] <= want[v][2]]
    assert sizes == {v: (len(below(v)), sum(want[u][3] for u in below(v))) for v in want}


def test_nested_text(spark, tmp_path):
    rows = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("z", None)]
    tree = tree_table(spark, rows)
    tour = tours.euler_tour(tree).cache()
    pieces = tours.nested_steps(tour, tree).cache()
    text = "".join(r["piece"] for r in pieces.filter("root = 'a'").orderBy("at").collect())
    assert json.loads(text) == {"id": "a", "name": "na", "children": [{"id": "b", "name": "nb", "children": [{"id": "d", "name": "nd", "children": []}, {"id": "e", "name": "ne", "children": []}]}, {"id": "c", "name": "nc", "children": []}]}
    tours.write_nested(pieces, str(tmp_path / "out"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    first, end = json.JSONDecoder().raw_decode(whole)
    assert first == json.loads(text) and json.loads(whole[end:])["id"] == "z"
    lines = [r["line"] for r in tours.outline(tour, tree, "outline").filter("root = 'a'").orderBy("at").collect()]
    assert lines == ["- a", "  - b", "    - d", "    - e", "  - c"]
    assert tours.euler_tour(tree.limit(0)).count() == 0


def test_a_chain_and_a_star(spark):
    """Depth costs rounds by its logarithm only; a root with most of the nodes is not one task."""
    chain = spark.range(5000).select(F.format_string("c%05d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("c%05d", F.col("id") - 1)).alias("parent_id"))
    star = spark.range(100_000).select(F.format_string("s%06d", "id").alias("id"), F.when(F.col("id") > 0, F.lit("s000000")).alias("parent_id"))
    tour = tours.euler_tour(chain.unionByName(star)).cache()
    assert tour.count() == 105_000
    r = tour.filter("id = 'c04999'").first()
    assert (r["root"], r["enter"], r["leave"], r["depth"]) == ("c00000", 4999, 5000, 4999)
    r = tour.filter("id = 's099999'").first()
    assert (r["root"], r["enter"], r["leave"], r["depth"]) == ("s000000", 2 * 99_998 + 1, 2 * 99_998 + 2, 1)


def test_leaves_are_not_ranked_by_doubling(spark, monkeypatch):
    """Of a star of 300 leaves, a chain and a mixed family only the steps of inner nodes are followed."""
    rows = [("hub", None)] + [(f"l{k:03}", "hub") for k in range(300)] + [("l010x", "l010"), ("l010y", "l010"), ("l200x", "l200"), ("alone", None), ("lost", "nowhere"), ("g1", "g2"), ("g2", "g1"), ("g3", "g1")]
    settled, ranked = G.settled, []
    monkeypatch.setattr(G, "settled", lambda df: (lambda x: (ranked.append(x.count()) if "far" in x.columns else None, x)[1])(settled(df)))
    got = {r["id"]: r for r in tours.euler_tour(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert max(ranked) <= 2 * 5  # hub, l010, l200, g1, g2

    kids, want = {}, {}
    for i, p in rows:
        kids.setdefault(p if p in {i for i, _ in rows} else None, []).append(i)

    def visit(i, root, at, depth):
        begin = at
        for k in sorted(kids.get(i, [])):
            at = visit(k, root, at + 1, depth + 1)
        want[i] = (root, begin, at + 1, depth)
        return at + 1

    for root in kids[None]:
        visit(root, root, 0, 0)
    assert {i: (r["root"], r["enter"], r["leave"], r["depth"]) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["is_leaf"]} == {i for i in want if i not in kids}
