"""Parsers on raw text and splitters by tokens against plain Python."""

import re

from conftest import DATA

from sparkweave import queries_items as QI
from sparkweave.operators import chunking, parse


def plain_multi_hop(text):
    """The rules of parse.multi_hop() in plain Python, for responses without fences, thoughts or preambles."""
    q, a = r"(?:Question|问题)", r"(?:Answer|答案|回答)"
    path = r"(?:Reasoning Path|Reasoning|Path|推理路径|推理|路径)"
    rest = rf"\n\s*(?:{q}|{a}|{path})\s*[:：]"
    space = " \t\n\x0b\x0c\r"

    def after(label):
        m = re.search(rf"{label}[{space}]*[:：][{space}]*(.*?)[{space}]*(?={rest}|\Z)", text, re.I | re.S | re.A)
        out = m[1].strip(" ") if m else ""
        return re.sub("^'+|'+$", "", re.sub('^"+|"+$', "", out))

    found, answer, way = after(q), after(a), after(path)
    line = answer.split("\n")[0].strip(" ")
    if not found and answer and re.search("[?？]|what|who|how|why|when|where|什么|谁|如何|为什么|何时|哪里", line.lower()):
        found, answer = line, answer.split("\n", 1)[1].strip(space) if "\n" in answer else answer
    first = re.match("[^。！？\n]*", text.strip(space))[0]
    if not found and len(first.strip(" ")) > 5:
        found, answer = first.strip(" "), text.strip(space)[len(first) :].strip(space)
    return (found, answer, way) if found and answer else None


def test_multi_hop_of_raw_turns(spark):
    want = {}
    for r in QI.raw_multi_hop(spark, DATA).collect():
        got = plain_multi_hop(r["response"])
        if got:
            want[tuple(r["batch_id"])] = got
    got = {(r["conv_id"], r["turn"]): (r["question"], r["answer"], r["reasoning_path"]) for r in QI.parse_multi_hop_raw(spark, DATA).collect()}
    assert len(want) > 20 and got == want


def test_multi_hop_leniency(spark):
    rows = [
        (1, "Question: A?\nAnswer: B\nPath: c"), (2, "Answer: Who did it?\nThe butler.\nPath: x"), (3, "The butler did it。Because of the money"), (4, "OK, Question: \"Q?\"\nAnswer: 'yes'"), (5, ""), (6, None),
        (7, "Here is a multi-hop question: \nQuestion: Z\nAnswer: W"), (8, "short"), (9, "```\nQuestion: in fence\nAnswer: yes\n```"),
    ]
    got = {r["batch_id"]: tuple(r)[1:] for r in parse.multi_hop(spark.createDataFrame(rows, "batch_id int, response string")).collect()}
    assert got == {1: ("A?", "B", "c"), 2: ("Who did it?", "The butler.", "x"), 3: ("The butler did it", "。Because of the money", ""), 4: ("Q?", "yes", ""), 7: ("Z", "W", ""), 9: ("in fence", "yes", "")}


def test_chunks_by_tokens(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    seen = {}
    for r in QI.token_chunks(spark, DATA).collect():
        assert docs[r["doc_id"]][r["start"] : r["start"] + len(r["content"])] == r["content"]
        # a piece without a finer separator is cut between characters, so a word may begin before its chunk
        assert len(chunking.word_starts(r["content"])) <= 121
        seen.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + len(r["content"])))
    for k, t in docs.items():
        assert all(i in seen.get(k, ()) or t[i].isspace() for i in range(len(t)))


def test_chinese_without_marks_stays_below_its_size():
    text = "天" * 100 + "。" + "地" * 30
    out = [c for _, c in chunking.splitter("zh", 16, 4).chunks(text)]
    assert max(map(len, out)) <= 17 and set("".join(out)) == set(text)


def plain_chunks(text, marks, size, overlap, ends=False):
    """Chunks by plain strings: cut at the coarsest mark that occurs, pack neighbours, cut what is too long more finely."""
    level = next((k for k, m in enumerate(marks) if m == "" or re.search(m, text)), len(marks) - 1)
    mark, finer = marks[level], marks[level + 1 :]
    if mark == "":
        pieces, finer = list(text), []
    else:
        places = [m.end() if ends else m.start() for m in re.finditer(mark, text)]
        bounds = sorted({0, len(text), *places})
        pieces = [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def packed(run):
        out, held = [], []
        for p in run:
            if held and len("".join(held)) + len(p) > size:
                out.append("".join(held))
                while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        return [*out, "".join(held)] if held else out

    out, run = [], []
    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        out += packed(run)
        run = []
        if finer:
            out += plain_chunks(p, finer, size, overlap, ends)
        else:
            out += packed(list(p)) if len(p) > size else [p]
    return out + packed(run)


def test_chunks_equal_plain_strings(spark):
    """Whole documents and pages by the library and by plain strings, at several sizes."""
    texts = {("documents", r["doc_id"]): r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    texts |= {("pages", r["page_id"]): r["html"] or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    texts |= {("own", 0): "# a\nb c d\n## e\n\nf" * 9, ("own", 1): "今天天气好。明天下雨！" * 30 + "天" * 90, ("own", 2): "x" * 400, ("own", 3): " \n\n ", ("own", 4): ""}
    plain = {"en": ([re.escape(m) for m in chunking.ENGLISH], False), "markdown": (list(chunking.MARKDOWN), False), "zh": (list(chunking.CHINESE), True)}
    for kind, (marks, ends) in plain.items():
        for size, overlap in ((1024, 100), (60, 12)):
            one = chunking.splitter(kind, size, overlap)
            for key, t in texts.items():
                t = t[:6000] if size == 60 else t
                want = [c.strip() for c in (plain_chunks(t, marks, size, overlap, ends) if t else []) if c.strip()]
                want = [re.sub(r"\n{2,}", "\n", c) for c in want] if kind == "zh" else want
                got = [c for _, c in one.chunks(t)]
                assert got == want, (kind, size, key)
                assert all(len(c) <= size for c in got)
