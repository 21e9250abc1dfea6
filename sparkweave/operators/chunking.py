"""Chunking documents: recursive, Markdown, Chinese and single-separator splitters.

A splitter works on spans (offsets) of one text, so pieces, windows and overlaps are
differences of offsets; documents are split in parallel inside mapInArrow.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T

#: Separators from coarse to fine (fixed values); '' splits into characters.
ENGLISH = ("\n\n", "\n", " ", "")
CHINESE = ("\n\n", "\n", "。|！|？", r"\.\s|\!\s|\?\s", r"；|;\s", r"，|,\s")
MARKDOWN = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "")


class Splitter:
    """Spans of chunks of a text; separators stay with the piece that they open (or end).

    starts: where the units that size and overlap count begin in a text, such as its tokens'
    offsets; characters by default.
    """

    def __init__(self, separators=ENGLISH, regex: bool = False, at_end: bool = False, size: int = 1024, overlap: int = 100, tidy: bool = False, starts=None):
        self.starts, self.units = starts, None
        self.levels = [None if s == "" else re.compile(s if regex else re.escape(s)) for s in separators]
        self.at_end, self.size, self.overlap, self.tidy = at_end, size, overlap, tidy

    def length(self, a: int, b: int) -> int:
        """Of text[a:b]: characters, or units that begin in it."""
        return b - a if self.units is None else bisect_left(self.units, b) - bisect_left(self.units, a)

    def cuts(self, text: str, a: int, b: int, level) -> list[int]:
        if level is None:
            return list(range(a, b + 1))
        marks = [m.end() if self.at_end else m.start() for m in level.finditer(text, a, b)]
        return sorted({a, b, *marks})

    def windows(self, cuts: list[int]):
        """Windows of neighbouring pieces of at most `size`, each beginning within `overlap` of the last one's end."""
        first = 0
        for k in range(1, len(cuts)):
            if self.length(cuts[first], cuts[k]) > self.size and k - 1 > first:
                yield cuts[first], cuts[k - 1]
                while first < k - 1 and (self.length(cuts[first], cuts[k - 1]) > self.overlap or self.length(cuts[first], cuts[k]) > self.size):
                    first += 1
        if first < len(cuts) - 1:
            yield cuts[first], cuts[-1]

    def spans(self, text: str, a: int, b: int, depth: int = 0):
        while depth < len(self.levels) - 1 and self.levels[depth] is not None and not self.levels[depth].search(text, a, b):
            depth += 1
        level = self.levels[depth]
        cuts = self.cuts(text, a, b, level)
        last = level is None or depth == len(self.levels) - 1
        run = [cuts[0]]
        for i, j in zip(cuts, cuts[1:]):
            if self.length(i, j) < self.size:
                run.append(j)
                continue
            yield from self.windows(run)
            if last and level is not None and self.length(i, j) > self.size:
                yield from self.windows(list(range(i, j + 1)))  # no mark to cut at
            elif last:
                yield i, j
            else:
                yield from self.spans(text, i, j, depth + 1)
            run = [j]
        yield from self.windows(run)

    def chunks(self, text: str) -> list[tuple[int, str]]:
        """(offset, chunk) with white space stripped and blank chunks dropped."""
        out = []
        self.units = self.starts(text) if self.starts and text else None
        for a, b in self.spans(text, 0, len(text)) if text else ():
            raw = text[a:b]
            chunk = raw.strip()
            if chunk:
                at = a + len(raw) - len(raw.lstrip())
                out.append((at, re.sub(r"\n{2,}", "\n", chunk) if self.tidy else chunk))
        return out


def splitter(kind: str, size: int, overlap: int, starts=None) -> Splitter:
    return {
        "en": lambda: Splitter(ENGLISH, size=size, overlap=overlap, starts=starts),
        "zh": lambda: Splitter(CHINESE, regex=True, at_end=True, size=size, overlap=overlap, tidy=True, starts=starts),
        "markdown": lambda: Splitter(MARKDOWN, regex=True, size=size, overlap=overlap, starts=starts),
    }[kind]()


def word_starts(text: str) -> list[int]:
    """Where words and single marks begin: units that every tokenizer's tokens are about as many as."""
    return [m.start() for m in re.finditer(r"\w+|[^\w\s]", text)]


def split_texts(docs: DataFrame, id_col: str, text_col: str, kind, size, overlap: int = 100, carry: tuple[str, ...] = (), starts=None) -> DataFrame:
    """(id_col, carried columns, pos, start, content): kind and size are Columns or constants.

    starts(text) -> sorted offsets: what size and overlap count, such as a tokenizer's tokens; characters by default.
    """

    def run(batches):
        made = {}
        for batch in batches:
            rows = {"i": [], "pos": [], "start": [], "content": []}
            for i, (t, k, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                one = made.get((k, s)) or made.setdefault((k, s), splitter(k, s, overlap, starts))
                for pos, (at, chunk) in enumerate(one.chunks(t or "")):
                    rows["i"].append(i)
                    rows["pos"].append(pos)
                    rows["start"].append(at)
                    rows["content"].append(chunk)
            held = [batch.column(c).take(pa.array(rows["i"], pa.int64())) for c in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(rows["pos"], pa.int32()), pa.array(rows["start"], pa.int32()), pa.array(rows["content"], pa.string())], names=[*names, "pos", "start", "content"])

    k = F.lit(kind) if isinstance(kind, str) else kind
    s = F.lit(size) if isinstance(size, int) else size
    names = [id_col, *carry]
    slim = docs.select(F.col(text_col), k.alias("k"), s.cast("int").alias("s"), *names)
    types = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)
    return slim.mapInArrow(run, f"{types}pos int, start int, content string")


def split_on_character(docs: DataFrame, id_col: str, text_col: str, separator: str = "\n\n", size: int = 1024, overlap: int = 0) -> DataFrame:
    """(id_col, pos, content): pieces between one separator, merged greedily up to size.  DataFrame functions only."""
    pieces = F.filter(F.split(F.col(text_col), re.escape(separator), -1), lambda x: x != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("now"))

    def add(acc, x):
        joined = F.concat(acc["now"], F.lit(separator), x)
        fits = F.length(joined) <= size
        return F.when(acc["now"].isNull(), F.struct(acc["done"].alias("done"), x.alias("now"))).when(
            fits, F.struct(acc["done"].alias("done"), joined.alias("now"))
        ).otherwise(F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), x.alias("now")))

    merged = F.aggregate(pieces, start, add, lambda acc: F.filter(F.array_append(acc["done"], F.coalesce(acc["now"], F.lit(""))), lambda x: F.trim(x) != ""))
    return docs.select(F.col(id_col), F.posexplode(merged).alias("pos", "content")).withColumn("content", F.trim("content"))


def chunk_documents(docs: DataFrame, size: int = 1024, overlap: int = 100, dynamic: bool = False) -> DataFrame:
    """docs(doc_id, type, content, ord) -> chunks(chunk_id, content, type, full_doc_id, length, language).

    The language picks the splitter; `dynamic` sizes chunks by length and complexity.  A chunk's id is
    the md5 of its content, so equal chunks of several documents are one row, of the last document by ord.
    Other types than text pass through under a chunk id of their own.
    """
    text = docs.filter("type = 'text' and trim(coalesce(content, '')) <> ''")
    text = text.withColumn("language", T.main_language("content"))
    text = text.withColumn("size", T.chunk_size_for(F.length("content"), T.complexity("content"), size) if dynamic else F.lit(size))
    pieces = split_texts(text, "doc_id", "content", F.col("language"), F.col("size"), overlap, carry=("language", "ord")).withColumn("chunk_id", T.content_hash("content", "chunk-"))
    best = F.max_by(F.struct("doc_id", "language"), F.struct("ord", "doc_id")).alias("x")
    chunks = pieces.groupBy("chunk_id").agg(F.first("content").alias("content"), best)
    chunks = chunks.select("chunk_id", "content", F.lit("text").alias("type"), F.col("x.doc_id").alias("full_doc_id"), F.length("content").cast("int").alias("length"), F.col("x.language").alias("language"))
    others = docs.filter("type <> 'text'").select(
        F.regexp_replace(F.col("doc_id").cast("string"), "^doc-", "chunk-").alias("chunk_id"), "content", "type", F.col("doc_id").alias("full_doc_id"),
        F.length("content").cast("int").alias("length"), F.lit(None).cast("string").alias("language"),
    )
    return chunks.unionByName(others)


def table_markdown(cells: DataFrame) -> DataFrame:
    """cells(table_id, row, col, value) -> (table_id, markdown): header, rule, rows padded to the widest."""
    safe = F.replace(F.replace(F.trim(F.coalesce("value", F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = cells.withColumn("v", safe).groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("cells"))
    rows = rows.withColumn("width", F.max(F.size("cells")).over(Window.partitionBy("table_id")))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rows = rows.select("table_id", "row", "width", line.alias("line"))
    lines = rows.groupBy("table_id").agg(F.first("width").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    return lines.select("table_id", F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))), "\n").alias("markdown"))
