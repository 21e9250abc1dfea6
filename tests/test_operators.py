"""Fixtures and invariants of operators that SQL does not express."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkweave import graph as G
from sparkweave.functions import text as T
from sparkweave.operators import assess, chunking, complete, evaluation, extract, parse, partition, prompts, taxonomy
from sparkweave.sources import exports, readers, tables
from sparkweave.streaming import ingest

FINANCE_NODES = [("credit_risk", "risk of loss", "concept"), ("market_risk", "risk of prices", "concept"), ("loan_default", "failure to pay", "event"), ("interest_rate", "cost of money", "metric"), ("collateral", "pledged asset", "asset"), ("basel_iii", "banking rules", "rule")]
FINANCE_EDGES = [("credit_risk", "loan_default", "leads to", "causes"), ("interest_rate", "market_risk", "drives", "affects"), ("collateral", "credit_risk", "reduces", "mitigates"), ("basel_iii", "credit_risk", "regulates", "regulates")]


def graph(spark):
    return spark.createDataFrame(FINANCE_NODES, "node_id string, description string, entity_type string"), spark.createDataFrame(FINANCE_EDGES, "src string, tgt string, description string, relation_type string")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_the_text(text, size, overlap):
    s = chunking.Splitter(size=size, overlap=overlap)
    seen = set()
    for at, chunk in s.chunks(text):
        assert len(chunk) <= size and text[at : at + len(chunk)] == chunk
        seen.update(range(at, at + len(chunk)))
    assert all(i in seen or text[i].isspace() for i in range(len(text)))


def test_chinese_chunks_end_at_marks():
    out = [c for _, c in chunking.splitter("zh", 8, 0).chunks("今天天气好。明天下雨！后天呢？再见")]
    assert "".join(out) == "今天天气好。明天下雨！后天呢？再见" and all(len(c) <= 9 for c in out)


def test_markdown_headings_open_chunks():
    text = "# One\nalpha beta\n## Two\ngamma delta\n## Three\nepsilon"
    assert [c.split("\n")[0] for _, c in chunking.splitter("markdown", 24, 0).chunks(text)] == ["# One", "## Two", "## Three"]


def test_extraction_records(spark):
    r = spark.createDataFrame([(1, '("entity"<|>"Rome"<|>"location"<|>"The capital")##("relationship"<|>"Nerva"<|>"Rome"<|>"ruled")##("entity"<|>"x")##("entity"<|> <|>a<|>b)##<|COMPLETE|>'), (2, "nothing"), (3, None)], "chunk_id int, response string")
    e, rel = extract.mentions(r)
    assert [tuple(x) for x in e.collect()] == [('"ROME"', '"LOCATION"', '"The capital"', 1)]
    assert [tuple(x) for x in rel.collect()] == [('"NERVA"', '"ROME"', '"ruled"', 1)]
    e, _ = extract.mentions(r, bare_names=True)
    assert e.first()[0] == "ROME"


def test_merge_counts_a_stored_node_once(spark):
    new = spark.createDataFrame([("A", "X", "d1", "c1"), ("A", "Y", "d2", "c2"), ("A", "Y", "d2", "c3")], "entity_name string, entity_type string, description string, source_id string")
    stored = spark.createDataFrame([("A", "X", ["d0"], ["c0"]), ("B", "Z", ["d"], ["c"])], "node_id string, entity_type string, descriptions array<string>, source_ids array<string>")
    got = {r["node_id"]: r for r in extract.merge_nodes(new, stored).collect()}
    assert got["A"]["entity_type"] == "X" and got["A"]["descriptions"] == ["d0", "d1", "d2"] and got["A"]["source_ids"] == ["c0", "c1", "c2", "c3"]
    assert got["B"]["entity_type"] == "Z"


def test_split_response_falls_back_to_the_whole(spark):
    g = spark.createDataFrame([("g", ["a", "b", "c"], "[Text 1]\none\n[Text 2]\ntwo"), ("h", ["d"], "plain")], "group_id string, chunk_ids array<string>, response string")
    got = {r[0]: r[1] for r in extract.split_response(g).collect()}
    assert got["a"] == "one" and got["b"] == "two" and got["c"].startswith("[Text 1]") and got["d"] == "plain"


@pytest.mark.parametrize("make", [lambda n, e: partition.bfs_communities(n, e, 3), lambda n, e: partition.dfs_communities(n, e, 3), lambda n, e: partition.loss_communities(n, e, 3, 100, sampling="max_loss")])
def test_communities_are_small_connected_and_disjoint(spark, make):
    nodes, edges = graph(spark)
    rows = make(nodes, edges).collect()
    assert len(rows) == len({r["unit_id"] for r in rows}) == 10
    links = {tuple(r) for r in partition.incidence(edges).collect()}
    by = {}
    for r in rows:
        by.setdefault(r["community_id"], set()).add(r["unit_id"])
    for units in by.values():
        assert len(units) <= 3
        reach, todo = set(), [next(iter(units))]
        while todo:
            u = todo.pop()
            reach.add(u)
            todo += [v for v in units if v not in reach and (u, v) in links]
        assert reach == units
    assert sorted(map(tuple, make(nodes, edges).collect())) == sorted(map(tuple, rows))


def test_anchors_and_missing_losses(spark):
    nodes, edges = graph(spark)
    rows = partition.anchored_communities(nodes, edges, 4, anchor_type="RULE").collect()
    assert {r["community_id"] for r in rows} == {"basel_iii"} and len(rows) == 4


def test_modularity_finds_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", "") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", "")]
    edges = spark.createDataFrame(pairs, "src string, tgt string, description string")
    nodes = edges.select(F.explode(F.array("src", "tgt")).alias("node_id")).distinct()
    got = partition.modularity_communities(nodes, edges)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["community_id"], set()).add(r["node_id"][0])
    assert all(len(g) == 1 for g in groups.values())
    assert partition.modularity(edges, got).first()[0] > 0.35


def test_cycles(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("X", "Y")], "src string, tgt string")
    assert {tuple(r) for r in G.cycle_core(e).collect()} == {("A", "B"), ("B", "C"), ("C", "A")}
    assert G.cycle_core(G.without_cycles(e)).count() == 0 and G.without_cycles(e).count() == 4


def test_path_edges_with_triangles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, tgt string")
    assert {tuple(r) for r in evaluation.on_paths_of_two(e).collect()} == {("b", "c"), ("a", "c"), ("c", "d")}


def test_hierarchy_of_animals(spark):
    n = spark.createDataFrame([(1, x, f"about {x}") for x in ("Animal", "Mammal", "Bird", "Cat")], "batch_id int, node_id string, description string")
    e = spark.createDataFrame([(1, "Mammal", "Animal"), (1, "Bird", "Animal"), (1, "Cat", "Mammal"), (1, "Cat", "whiskers")], "batch_id int, src string, tgt string")
    text = prompts.hierarchy_text(n, e, "outline", reverse=True).first()["text"].split("\n")
    assert text[:4] == ["- Animal: about Animal", "  - Bird: about Bird", "  - Mammal: about Mammal", "    - Cat: about Cat"] and "- whiskers" in text


NESTED = {"nodes": [{"id": "root-1", "name": "R1", "cognitive_dimension": "rule_compliance", "children": [{"id": "child-1a", "name": "A", "children": [{"id": "leaf-1a1", "name": "x"}, {"id": "leaf-1a2", "name": "y"}]}, {"id": "child-1b", "name": "B"}]}, {"id": "root-2", "name": "R2", "children": [{"id": "child-2a", "name": "C"}]}]}


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(NESTED))
    tree = readers.read_taxonomy(spark, f"file://{tmp_path}/t.json")
    d = taxonomy.with_depth(tree)
    assert tree.count() == 7 and d.agg(F.max("depth")).first()[0] == 2
    assert {r["id"] for r in d.filter("is_leaf").collect()} == {"leaf-1a1", "leaf-1a2", "child-1b", "child-2a"}
    paths = taxonomy.closure(tree)
    assert [r["id"] for r in taxonomy.branch(paths, "leaf-1a1").orderBy("position").collect()] == ["root-1", "child-1a", "leaf-1a1"]
    assert taxonomy.subtree(paths, "root-1").count() == 5
    assert {r["rule"] for r in taxonomy.validate(tree.unionByName(spark.createDataFrame([("o", "O", None, "odd", "gone")], readers.TAXONOMY))).collect()} == {"orphan", "unknown_dimension"}
    text, roots = "".join(r["piece"] for r in taxonomy.nested_json(tree).orderBy("root", "at").collect()), []
    while text:
        root, end = json.JSONDecoder().raw_decode(text)
        roots, text = [*roots, root], text[end:]
    assert roots[0]["children"][0]["children"][1]["id"] == "leaf-1a2"
    assert taxonomy.sample_branches(tree, 2).select("root").distinct().count() == 2
    got = taxonomy.sample_uncovered(tree, spark.createDataFrame([("leaf-1a1",), ("child-1b",)], "id string"), 3).collect()
    assert [r["is_leaf"] for r in got] == [True, True, False]
    cov = {(r["what"], r["value"]): r["ratio"] for r in taxonomy.coverage(tree, spark.createDataFrame([("leaf-1a1",)], "id string")).collect()}
    assert cov["leaf", None] == 0.25


def test_intent_links(spark):
    nodes, edges = graph(spark)
    intents = spark.createDataFrame([(1, "credit risk of loan"), (2, "的 xyz")], "intent_id int, text string")
    got = [(r["intent_id"], r["node_id"], round(r["score"], 3)) for r in taxonomy.link_intents(intents, nodes, 0.5).collect()]
    assert (1, "credit_risk", 0.667) in got and all(i == 1 for i, _, _ in got)
    assert "credit_risk" in taxonomy.intent_subgraphs(intents, nodes, edges).first()["text"]


def test_responses(spark):
    one = lambda s, f: f(spark.createDataFrame([(1, s)], "batch_id int, response string")).first()
    assert one("Question: what?\nAnswer: that", parse.intent_pairs)[1:] == ("what?", "that")
    assert one("问题：什么？\n答案：那个", parse.intent_pairs)[1:] == ("什么？", "那个")
    assert one("first line\nsecond line", parse.intent_pairs)[1:] == ("first line", "second line")
    assert one("**Q1:** why?\n**A1:** because\n---\n**Q2:** how?\n**A2:** so", parse.atomic_pairs)[2:] == ("why?", "because")
    assert one("What is it?", parse.only_questions)[1] == "What is it?"
    assert one("<think>hm</think>Answer: yes it is", parse.only_answers)[1] == "yes it is"
    assert one("Rephrased Text: a b c\nQuestion: d?", parse.aggregated_parts)[1:] == ("a b c", "d?")
    assert one("Question: q\nReasoning-Path Design: p", parse.chain_of_thought)[1:3] == ("q", "p")
    assert one("so it goes. The end.", parse.chain_of_thought)[4] == "The end."
    assert one("Question: q\nAnswer: a\nHierarchical Reasoning: h", parse.hierarchical)[1:] == ("q", "a", "h")
    v = lambda s: parse.critic_verdicts(spark.createDataFrame([(1, s)], "item_id int, response string")).first()
    assert v('```json\n{"overall_score": 1.7, "passed": false, "reason": "r", "suggestions": ["s"],}\n```')[1:] == (False, 1.0, "r", ["s"])
    assert v("no json")[1:3] == (True, 0.5)
    t, bad = parse.taxonomy_nodes(spark.createDataFrame([(1, json.dumps(NESTED)), (2, "oops")], "doc_id int, response string"))
    assert t.count() == 7 and bad.count() == 1


def test_completion_retries_and_failures(spark):
    p = spark.createDataFrame([("a",), ("b",), ("",)], "prompt string")
    got = {r["prompt"]: (r["response"], r["status"]) for r in complete.complete(p, lambda xs: [x * 2 for x in xs]).collect()}
    assert got == {"a": ("aa", "ok"), "b": ("bb", "ok"), "": ("", "empty")}

    def broken(xs):
        raise RuntimeError

    assert {(r["status"], r["attempts"]) for r in complete.complete(p, broken, retries=1).collect()} == {("failed", 2)}
    s = complete.scored(spark.createDataFrame([("q", "a")], "question string, answer string"), lambda xs: [len(x) for x in xs])
    assert s.first()["score"] == len("question: q answer: a")


def test_losses(spark):
    j = spark.createDataFrame([(1, "yes", "yes", 0.5), (1, "no", "yes", 0.5), (2, "yes", "maybe", 0.9), (3, "yes", "no", 1.0)], "unit_id int, gt string, token string, prob double")
    got = {r[0]: round(r[1], 4) for r in assess.losses(j, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "unit_id int")).collect()}
    assert got == {1: 0.6931, 2: 2.3026, 3: 2.3026, 4: 2.3026}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.jsonl").write_text('{"type": "text", "content": "x"}\nnot json\n{"type": "text", "content": "y"}\n')
    (tmp_path / "d.json").write_text('[{"type": "text", "content": "j"}]')
    (tmp_path / "e.csv").write_text('type,content\ntext,"a, b"\n')
    f = f"file://{tmp_path}"
    docs = readers.read_documents(spark, [f"{f}/{x}" for x in ("a.txt", "b.md", "c.jsonl", "d.json", "e.csv")])
    assert sorted(r["content"] for r in docs.collect()) == ["a, b", "café", "j", "one\n\ntwo", "x", "y"]
    assert readers.read_jsonl(spark, f"{f}/c.jsonl")[1].count() == 1
    with pytest.raises(ValueError):
        readers.read_documents(spark, ["x.exe"])
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="n1"><data key="d0">t</data></node><node id="n2"/><edge source="n1" target="n2"><data key="d1">e</data></edge></graph></graphml>')
    n, e = readers.read_graphml(spark, f"{f}/g.graphml")
    assert n.count() == 2 and e.first()["src"] == "n1" and {r["attributes"].get("d0") for r in n.collect()} == {"t", None}
    (tmp_path / "r.json").write_text('{"items": [{"id": "eval_x", "q": 1}, {"q": 2}]}')
    assert [r["item_id"] for r in readers.read_review_items(spark, f"{f}/r.json", "t").orderBy("pos").collect()] == ["eval_x", "t_1"]
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "1.json").write_text('{"k": {"question": "a"}}')
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.jsonl").write_text('{"q": 1}\nbroken\n\n{"id": "eval_y"}\n{"q": 2}')
    (tmp_path / "many" / "b.json").write_text('[{"q": 3}, {"q": 4}]')
    assert [r["item_id"] for r in readers.read_review_items(spark, f"file://{tmp_path}/many", "t").orderBy("pos").collect()] == ["t_0", "eval_y", "t_2", "t_3", "t_4"]
    assert readers.read_qa_folder(spark, f"{f}/qa").first()["key"] == "k"


def test_first_write_wins(spark):
    store = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert sorted(map(tuple, tables.insert_absent(store, new, "k", "v").collect())) == [(1, "old"), (2, "a")]


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("text", f"Alpha Beta Gamma number {i}. Delta Epsilon follows Beta{i % 3}.", i) for i in range(12)]
    schema = "type string, content string, ord long"
    for k in range(2):
        spark.createDataFrame(rows[6 * k : 6 * k + 8], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = ingest.Store(spark, f"{tmp_path}/store")
    ingest.ingest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp").awaitTermination()
    whole = ingest.Store(spark, f"{tmp_path}/whole")
    ingest.ingest_batch(whole, spark.createDataFrame(rows, schema), 0)
    a, b = (sorted(map(str, s.graph()[0].collect())) for s in (store, whole))
    assert a == b and a


def test_reviewed_export(spark):
    x = spark.createDataFrame([(1, ("a",), "approved", None), (2, ("b",), "modified", ("c",)), (3, ("d",), "pending", None)], "item_id int, content struct<q:string>, review_status string, modified_content struct<q:string>")
    x = x.withColumns({"review_comment": F.lit(""), "reviewer": F.lit(""), "review_time": F.lit("")})
    assert sorted((r["item_id"], r["q"]) for r in exports.reviewed(x, ["approved", "modified"]).collect()) == [(1, "a"), (2, "c")]


def test_text_functions(spark):
    x = spark.createDataFrame([(" a &lt;b&gt; &amp; \x01",)], "t string")
    assert x.select(T.clean("t")).first()[0] == "a <b> & " and x.select(T.clean_all_entities("t")).first()[0] == "a <b> & "
    y = spark.createDataFrame([("大数据 Graph graphs of x",)], "t string")
    assert set(y.select(T.keywords("t")).first()[0]) == {"大", "数", "据", "大数", "数据", "graph", "graphs"}
    z = spark.createDataFrame([("Sure, here is the answer:\n{'a': None}",)], "t string")
    assert z.select(T.without_chatter("t")).first()[0] == "{'a': None}"


def test_lone_siblings_try_their_other_parents(spark):
    edges = spark.createDataFrame([(c, "P") for c in "abcx"] + [("x", "Q"), ("y", "Q"), ("z", "R")], "src string, tgt string")
    got = partition.sibling_groups(edges, max_siblings=3).collect()
    assert sorted((r.community_id, r.node_id) for r in got if r.role == "child") == [("P/0", "a"), ("P/0", "b"), ("P/0", "c"), ("Q/+0", "x"), ("Q/+0", "y")]
    assert sorted(r.node_id for r in got if r.role == "parent") == ["P", "Q"]
    assert partition.sibling_groups(edges.limit(0)).count() == 0


def test_graphml_part_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "FILE_ELEMENTS", 10, raising=False)
    note = lambda c: F.create_map(F.lit("note"), F.col(c).cast("string"))
    nodes = spark.range(95).coalesce(1).select(F.concat(F.lit("n"), "id").alias("node_id"), note("id").alias("attributes"))
    edges = spark.range(31).coalesce(1).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("n0").alias("tgt"), note("id").alias("attributes"))
    exports.write_graphml(nodes, edges, f"file://{tmp_path}/g")
    assert [len(list((tmp_path / "g" / k).glob("part-*"))) for k in ("nodes", "edges")] == [10, 4]
    n = readers.read_graphml(spark, f"file://{tmp_path}/g/nodes")[0].collect()
    e = readers.read_graphml(spark, f"file://{tmp_path}/g/edges")[1].collect()
    assert sorted((r["node_id"], r["attributes"]["note"]) for r in n) == sorted((f"n{i}", str(i)) for i in range(95))
    assert sorted((r["src"], r["tgt"], r["attributes"]["note"]) for r in e) == sorted((f"n{i}", "n0", str(i)) for i in range(31))
