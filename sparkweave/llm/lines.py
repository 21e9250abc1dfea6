"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

Each task sets the bits of its lines in two filters: keys seen once, and keys seen again.
The filters of all tasks are merged by OR, segment by segment; what two tasks have both
seen once is seen twice.  The twice filter goes to every task, and only lines that it knows
(suspected repeats) leave their task: their keys meet for exact confirmation and the choice
of the first document.  Documents without a suspect are done where they are; the texts of
the others follow their answers.

The filter's size comes from a count of lines.  Beyond FILTER_BYTES it is not broadcast:
sorted hashes then meet by bucket through a shuffle, with filters of their own there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import _blocks as B

#: The twice filter is broadcast up to this size; 16 bits a line, so 32 million lines.
FILTER_BYTES = 64 << 20
BITS, PROBES, SEGMENT = 16, 5, 19


class Filters:
    """Bloom filters for hashes seen once and seen twice, as bit arrays in segments of 64 KB; a hash lies in one segment."""

    def __init__(self, keys: int):
        self.segments = max(1, -(-keys * BITS >> SEGMENT))
        self.once, self.twice = (np.zeros(self.segments << SEGMENT - 3, np.uint8) for _ in range(2))

    def _at(self, h: np.ndarray) -> np.ndarray:
        segment = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        low = B.mix(h)
        probe = np.arange(PROBES, dtype=np.uint64)[:, None] * ((low >> np.uint64(32)) | np.uint64(1))
        return ((segment << np.uint64(SEGMENT)) | ((low + probe) & np.uint64((1 << SEGMENT) - 1))).astype(np.int64)

    @staticmethod
    def _set(bits: np.ndarray, at: np.ndarray) -> None:
        at = np.sort(at, axis=None)
        new = np.flatnonzero(np.diff(at >> 3, prepend=-1))
        if len(new):
            bits[at[new] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), new)

    @staticmethod
    def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)

    def add(self, h: np.ndarray, many: np.ndarray) -> None:
        """Distinct hashes, and which of them count as seen twice by themselves."""
        at = self._at(h)
        self._set(self.twice, at[:, self._has(self.once, at) | many])
        self._set(self.once, at)

    def suspected(self, h: np.ndarray) -> np.ndarray:
        return self._has(self.twice, self._at(h))


def suspects(h: np.ndarray, many: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which hashes may occur in two parts, or occur twice in one (many); none that does is missed."""
    both = Filters(len(h))
    cut = np.flatnonzero(np.diff(part)) + 1
    for i, j in zip([0, *cut], [*cut, len(h)]):
        both.add(h[i:j], many[i:j] > 0)
    return both.suspected(h).astype(np.uint8)


class Lines:
    """The lines of a block and their keys: stripped of white space at both ends, A-Z lower-cased."""

    def __init__(self, block: B.Block):
        stop = np.flatnonzero(block.data == 10)  # each document ends with one too
        self.start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
        self.stop = stop
        self.first = np.searchsorted(stop, block.starts)
        self.last = np.searchsorted(stop, block.ends) + 1
        self.doc = np.repeat(np.arange(len(block.ids)), self.last - self.first)
        ink = np.flatnonzero(~B.SPACE[block.data])
        i, j = np.searchsorted(ink, self.start), np.searchsorted(ink, stop)
        has = i < j
        self.a = np.where(has, ink[np.minimum(i, len(ink) - 1)], self.start) if len(ink) else self.start
        self.b = np.where(has, ink[np.maximum(j - 1, 0)] + 1, self.start) if len(ink) else self.start
        points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        self.chars = points[self.b] - points[self.a]
        self.low = B.LOWER[block.data]
        self.bytes = self.low.tobytes()
        self.hash = B.Rolling(B.BYTE[self.low]).at(self.a, self.b)

    def key(self, i: int) -> bytes:
        return self.bytes[self.a[i] : self.b[i]]


def _long_lines(block: B.Block, min_chars: int) -> tuple[Lines, np.ndarray]:
    lines = Lines(block)
    return lines, np.flatnonzero(lines.chars >= min_chars)


def seen_twice(blocks: DataFrame, keys: int, min_chars: int) -> Filters:
    """The filters of all blocks, merged: each task's by segment, a segment's by OR."""

    def fill(batches):
        own = Filters(keys)
        for batch in batches:
            for k in range(batch.num_rows):
                _, block = B.first_block(pa.Table.from_batches([batch.slice(k, 1)]))
                lines, at = _long_lines(block, min_chars)
                h, _, many = B.distinct_by_doc(lines.hash[at], block.ids[lines.doc[at]])
                own.add(h, many)
        press = zstandard.ZstdCompressor(level=1).compress
        once, twice = (x.reshape(own.segments, -1) for x in (own.once, own.twice))
        some = np.flatnonzero(once.any(axis=1))
        yield pa.RecordBatch.from_pydict({
            "segment": some, "once": pa.array([press(once[i].tobytes()) for i in some], pa.binary()), "twice": pa.array([press(twice[i].tobytes()) for i in some], pa.binary()),
        })

    def merge(table: pa.Table) -> pa.Table:
        opened = zstandard.ZstdDecompressor()
        once, twice = (np.zeros(1 << SEGMENT - 3, np.uint8) for _ in range(2))
        for o, t in zip(table.column("once"), table.column("twice")):
            o, t = (np.frombuffer(opened.decompress(x.as_py()), np.uint8) for x in (o, t))
            twice |= once & o | t
            once |= o
        return pa.table({"segment": table.column("segment").slice(0, 1), "twice": pa.array([zstandard.ZstdCompressor(level=1).compress(twice.tobytes())], pa.binary())})

    out = Filters(keys)
    bits = out.twice.reshape(out.segments, -1)
    merged = blocks.mapInArrow(fill, "segment long, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment long, twice binary")
    for r in merged.collect():  # FILTER_BYTES at most
        bits[r["segment"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["twice"])), np.uint8)
    return out


def _split(docs: DataFrame, min_chars: int, carry: bool, finish, result: StructType, filter_bytes: int) -> DataFrame:
    """finish(block, lines, drop) -> table of result, for each document once its repeated lines are known."""
    spark = docs.sparkSession
    blocks = B.pack(docs, carry=carry)
    keys = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    names = [f.name for f in result.fields]

    def told(number, block, suspected):
        """Rows of three kinds: suspected keys, the documents that have one (as a block), and all others, done."""
        lines, at = _long_lines(block, min_chars)
        at = at[suspected(lines, at)]
        span: dict[bytes, list[int]] = {}
        for i, d in zip(at.tolist(), block.ids[lines.doc[at]].tolist()):
            x = span.setdefault(lines.key(i), [d, d])
            x[0], x[1] = min(x[0], d), max(x[1], d)
        touched = np.zeros(len(block.ids), bool)
        touched[lines.doc[at]] = True
        done = finish(block, lines, np.zeros(len(lines.start), bool)).filter(pa.array(~touched))
        held = block.part(np.flatnonzero(touched))
        n = (len(span), int(touched.any()), done.num_rows)
        empty = lambda kind, k: pa.nulls(k, kind)
        three = lambda kind, *x: pa.chunked_array([c if c is not None else empty(kind, k) for c, k in zip(x, n)], kind)
        rows = pa.StructArray.from_arrays([done.column(c).combine_chunks() for c in names], names) if done.num_rows else None
        columns = {"block": pa.array([number] * sum(n), pa.int64()), "key": three(pa.binary(), pa.array(list(span), pa.binary()), None, None)}
        for j, c in enumerate(("lo", "hi")):
            columns[c] = three(pa.int64(), pa.array([x[j] for x in span.values()], pa.int64()), None, None)
        for c in ("ids", "lens", "body", "rest"):
            columns[c] = three(pa.binary(), None, pa.array([held[c]] * n[1], pa.binary()), None)
        kind = pa.struct(list(done.schema))
        columns["row"] = three(kind, None, None, rows)
        return pa.table(columns)

    schema = StructType.fromDDL("block long, key binary, lo long, hi long, ids binary, lens binary, body binary, rest binary").add("row", result)
    if keys * BITS // 8 <= filter_bytes:
        filters = spark.sparkContext.broadcast(seen_twice(blocks, keys, min_chars))
        run = lambda number, block: told(number, block, lambda lines, at: filters.value.suspected(lines.hash[at])).combine_chunks().to_batches()

        def each(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from run(*B.first_block(pa.Table.from_batches([batch.slice(k, 1)])))

        out = blocks.mapInArrow(each, schema).checkpoint()
    else:
        buckets = B.buckets_for(blocks, share=0.1)

        def send(number, block):
            lines, at = _long_lines(block, min_chars)
            h, _, many = B.distinct_by_doc(lines.hash[at], block.ids[lines.doc[at]])
            return B.sent(number, h, many.astype(np.uint8), buckets)

        def known(got):
            def suspected(lines, at):
                h = np.unique(lines.hash[at])
                return (B.answers_for(h, got, buckets, np.uint8) > 0)[np.searchsorted(h, lines.hash[at])] if len(at) else np.zeros(0, bool)

            return suspected

        answers = B.exchange(B.each_block(blocks, send, B.SENT_SCHEMA), suspects, np.uint8)
        out = B.per_block(blocks, answers, lambda number, block, got: told(number, block, known(got)), schema).checkpoint()
    rows = out.filter("key is not null").select("block", "key", "lo", "hi")
    least = rows.groupBy("key").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least < most").drop("most")
    answers = rows.select(F.col("block").alias("block"), "key").join(least, "key")

    def answered(number, block, wanted):
        lines, drop = _dropped(block, wanted, min_chars)
        return finish(block, lines, drop)

    held = B.with_rows(out.filter("body is not null").select("block", "ids", "lens", "body", "rest"), answers, answered, result)
    return out.filter("row is not null").select("row.*").unionByName(held)


def _dropped(block: B.Block, wanted: pa.Table, min_chars: int) -> tuple[Lines, np.ndarray]:
    lines = Lines(block)
    least = dict(zip(wanted.column("key").to_pylist(), wanted.column("least").to_pylist()))
    drop = np.zeros(len(lines.start), bool)
    if least:
        data = np.frombuffer(b"".join(least), np.uint8)
        ends = np.cumsum([len(x) for x in least])
        known = np.sort(B.Rolling(B.BYTE[data]).at(np.concatenate([[0], ends[:-1]]), ends))
        at = np.minimum(np.searchsorted(known, lines.hash), len(known) - 1)
        for i in np.flatnonzero((known[at] == lines.hash) & (lines.chars >= min_chars)).tolist():
            d = least.get(lines.key(i))
            drop[i] = d is not None and d != block.ids[lines.doc[i]]
    return lines, drop


def _kept(block: B.Block, lines: Lines, drop: np.ndarray, i: int) -> bytes:
    a, b = int(lines.first[i]), int(lines.last[i])
    if not drop[a:b].any():
        return block.text(i)
    return b"\n".join(block.body[lines.start[k] : lines.stop[k]] for k in range(a, b) if not drop[k])


def line_report(docs: DataFrame, min_chars: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Drop lines whose key occurs in two documents, except in the smallest doc_id that holds it.

    Returns one row per row of docs: doc_id, n_lines (before), n_dropped, kept_sha256.
    A line's key is the line without white space at its ends, A-Z lower-cased; keys under
    min_chars code points stay.  Null or empty text is one empty line.  A null doc_id sorts
    before all others; rows that share a doc_id are one document.  Other columns are ignored.
    """

    def report(block, lines, drop):
        sums = np.concatenate([[0], np.cumsum(drop)])
        return pa.table({
            "doc_id": B.ids_out(block.ids), "n_lines": lines.last - lines.first, "n_dropped": sums[lines.last] - sums[lines.first],
            "kept_sha256": [hashlib.sha256(_kept(block, lines, drop, i)).hexdigest() for i in range(len(block.ids))],
        })

    result = StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return _split(docs, min_chars, False, report, result, filter_bytes)


def without_repeated_lines(docs: DataFrame, min_chars: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows and columns of docs, with such lines dropped from text (a null text becomes empty)."""
    names = [c for c in docs.columns if c != "text"]

    def cut(block, lines, drop):
        text = pa.array([_kept(block, lines, drop, i).decode() for i in range(len(block.ids))], pa.string())
        return pa.table([*block.columns().columns, text], names=[*named, "_text"])

    named = [f"_{k}" for k in range(len(names))]  # whatever the names of docs are
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    result = StructType()
    for c, n in zip(names, named):
        result.add(n, kinds[c])
    result.add("_text", "string")
    out = _split(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), min_chars, True, cut, result, filter_bytes)
    of = dict(zip(names, named)) | {"text": "_text"}
    return out.select(*[F.col(of[c]).alias(c) for c in docs.columns])
