"""Blocks of whole documents, and exchanges of hashes between blocks and buckets.

Substring-level operators work on *blocks*: rows that hold a few MB of whole
documents, compressed.  A block never splits a document.  Every pass over the
corpus is a Spark job over blocks; what must meet across blocks (hashes of
anchors, windows, lines or words) is sent as sorted arrays, one per block and
bucket, and shuffled by bucket, so that a value that occurs in every document
is still one entry per block.  Answers return to the block by a cogroup.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Stands for a null doc_id; smaller than every other.
NULL_ID = np.iinfo(np.int64).min
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, ids binary, lens binary, body binary, raw long, rest binary"
_COLUMNS = ("ids", "lens", "body", "rest")

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n at least."""
    if len(_POW[0]) < n:
        size = max(n, 3 << 19)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _POW[k] = np.multiply.accumulate(out)
    return _POW[0], _POW[1]


class Rolling:
    """Hashes of any substring of a sequence of 64-bit symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * p[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def every(self, length: int) -> np.ndarray:
        """Of each substring of this length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Documents one after another in one byte array, each followed by a newline."""

    def __init__(self, ids: bytes, lens: bytes, body: bytes, rest: bytes = b"", packed: bool = True):
        self.rest = rest
        self.ids = np.frombuffer(ids, np.int64)
        self.lens = np.frombuffer(lens, np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(body) if packed else body
        self.data = np.frombuffer(self.body, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lens + 1)])[:-1].astype(np.int64)
        self.ends = self.starts + self.lens

    @classmethod
    def of(cls, ids, texts: list[bytes]) -> "Block":
        raw = b"\n".join([*texts, b""])
        lens = np.array([len(x) for x in texts], np.int64)
        return cls(np.array(ids, np.int64).tobytes(), lens.tobytes(), raw, packed=False)

    def text(self, i: int) -> bytes:
        return self.body[self.starts[i] : self.ends[i]]

    def part(self, which: np.ndarray) -> dict[str, bytes]:
        """Some of the documents, in order, as the columns of a block of their own."""
        body = b"".join(self.body[a : b + 1] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist()))
        held = pa.BufferOutputStream()
        if self.rest:
            table = self.columns().take(pa.array(which))
            with pa.ipc.new_stream(held, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
        return {
            "ids": self.ids[which].tobytes(), "lens": self.lens[which].tobytes(),
            "body": zstandard.ZstdCompressor(level=3).compress(body), "rest": held.getvalue().to_pybytes(),
        }

    def columns(self) -> pa.Table:
        """The other columns that pack() was told to carry."""
        return pa.ipc.open_stream(self.rest).read_all()

    def words(self, lower: bool = False, gaps: np.ndarray | None = None) -> "Words":
        """gaps: the bytes between words, white space by default; a newline must be one."""
        return Words(self, lower, gaps)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block: starts, ends, hashes, and each document's range."""

    def __init__(self, block: Block, lower: bool = False, gaps: np.ndarray | None = None):
        space = (SPACE if gaps is None else gaps)[block.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]  # a block ends with a newline
        data = LOWER[block.data] if lower else block.data
        self.hash = Rolling(BYTE[data]).at(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, block.starts)
        self.last = np.searchsorted(self.starts, block.ends)
        self.doc = np.repeat(np.arange(len(block.ids)), self.last - self.first)


def ids_out(ids) -> pa.Array:
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def pack(docs: DataFrame, carry: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) as blocks, checkpointed: the numbering of blocks must survive lost executors.

    A null text is an empty one.  Duplicate rows stay separate documents.  carry: all
    columns of docs come along, whatever their names, for Block.columns().
    """
    spark = docs.sparkSession
    prepare(spark)

    def to_blocks(batches):
        task, seq = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        ids, texts, size, rest = [], [], 0, []

        def flush():
            nonlocal ids, texts, size, seq, rest
            held = pa.BufferOutputStream()
            if carry:
                table = pa.Table.from_batches(rest)
                with pa.ipc.new_stream(held, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
            raw = b"\n".join([*texts, b""])
            row = pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + seq], pa.int64()),
                "ids": [np.array(ids, np.int64).tobytes()],
                "lens": [np.array([len(x) for x in texts], np.int64).tobytes()],
                "body": [press.compress(raw)],
                "raw": pa.array([len(raw)], pa.int64()),
                "rest": pa.array([held.getvalue().to_pybytes()], pa.binary()),
            })
            ids, texts, size, seq, rest = [], [], 0, seq + 1, []
            return row

        for batch in batches:
            others = pa.RecordBatch.from_arrays(batch.columns[2:], names=names)
            since = 0
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                t = b"" if not t.is_valid else t.as_buffer().to_pybytes()
                if ids and size + len(t) > block_bytes:
                    rest.append(others.slice(since, k - since))
                    yield flush()
                    since = k
                ids.append(NULL_ID if i is None else i)
                texts.append(t)
                size += len(t) + 1
            rest.append(others.slice(since))
        if ids:
            yield flush()

    names = [c for c in docs.columns if c != "text"] if carry else []
    cols = docs.select(
        F.col("doc_id").cast("long").alias("_0"), F.col("text").cast("string").alias("_1"),
        *[F.col(f"`{c}`").alias(f"_{k + 2}") for k, c in enumerate(names)],
    )
    return cols.mapInArrow(to_blocks, BLOCK_SCHEMA).checkpoint()


def text_bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def in_blocks(batch: pa.RecordBatch, column: str = "text", block_bytes: int = BLOCK_BYTES):
    """(slice of the batch, its texts as a Block), each of about block_bytes; ids are row numbers."""
    texts = text_bytes(batch.column(batch.schema.get_field_index(column)))
    since = size = 0
    for k, t in enumerate(texts):
        if k > since and size + len(t) > block_bytes:
            yield batch.slice(since, k - since), Block.of(range(k - since), texts[since:k])
            since, size = k, 0
        size += len(t) + 1
    if len(texts) > since:
        yield batch.slice(since), Block.of(range(len(texts) - since), texts[since:])


def with_small(df: DataFrame, small: DataFrame, on: str, limit: int = 10_000) -> DataFrame:
    """Left join with a table of one row per key: broadcast where a count proves it small, else shuffled."""
    few = small.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(small) if few else small, on, "left")


def prepare(spark) -> None:
    """Arrow batches of a bounded size, as texts may be long; and a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_checkpoint_dir(spark)


def shared_checkpoint_dir(spark) -> None:
    """Use the cluster's spark.checkpoint.dir; only in local mode (tests) may a folder of our own stand in."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def buckets_for(blocks: DataFrame, share: float = 0.3, target: int = 32 << 20, least: int = 256) -> int:
    """So many buckets that one holds about `target` bytes if hashes take `share` of the text."""
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return int(max(least, raw * share / target))


def slices(hashes: np.ndarray, buckets: int):
    """(bucket, from, to) for each bucket that has some of these sorted hashes."""
    of = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(of)) + 1
    lo = np.concatenate([[0], cut]).astype(np.int64)
    hi = np.concatenate([cut, [len(of)]]).astype(np.int64)
    if len(of):
        yield from zip(of[lo].tolist(), lo.tolist(), hi.tolist())


SENT_SCHEMA = "bucket int, block long, h binary, v binary"
BACK_SCHEMA = "block long, bucket int, r binary"


def sent(block: int, hashes: np.ndarray, values: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Sorted, distinct hashes of a block (and a value each), cut by bucket."""
    rows = list(slices(hashes, buckets))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
        "block": pa.array([block] * len(rows), pa.int64()),
        "h": pa.array([hashes[i:j].tobytes() for _, i, j in rows], pa.binary()),
        "v": pa.array([b"" if values is None else values[i:j].tobytes() for _, i, j in rows], pa.binary()),
    })


def exchange(rows: DataFrame, decide, value_type=None, press: bool = False) -> DataFrame:
    """Per bucket: decide(hashes, values, part) -> one answer per entry, sent back to the entry's block.

    hashes and values are those of all blocks one after another; part numbers the block of each entry.
    press: answers are compressed; see pressed().
    """

    def one(table: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("h").chunks for x in c]
        n = [len(x) for x in hs]
        values = None
        if value_type is not None:
            values = np.concatenate([np.frombuffer(x.as_buffer(), value_type) for c in table.column("v").chunks for x in c])
        answer = decide(np.concatenate(hs), values, np.repeat(np.arange(len(n)), n))
        shut = zstandard.ZstdCompressor(level=1).compress if press else bytes
        cut = np.cumsum([0, *n])
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "r": pa.array([shut(answer[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
        })

    return rows.groupBy("bucket").applyInArrow(one, BACK_SCHEMA)


def per_block(blocks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(block number, Block, {bucket: answer bytes}) -> record batch or table, for each block."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        number, block = first_block(left)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("r").to_pylist()))
        out = fn(number, block, got)
        return out if isinstance(out, pa.Table) else pa.Table.from_batches([out])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)


def with_rows(blocks: DataFrame, rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn(block number, Block, rows of that block) -> table, for each block; rows has a column block."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(*first_block(left), right)

    return blocks.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(one, schema)


def first_block(table: pa.Table) -> tuple[int, Block]:
    return table.column("block")[0].as_py(), Block(*(table.column(c)[0].as_py() for c in _COLUMNS))


def each_block(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """fn(block number, Block) -> record batch, for each block."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield fn(*first_block(pa.Table.from_batches([batch.slice(k, 1)])))

    return blocks.mapInArrow(run, schema)


def pressed(got: dict) -> dict:
    """Compressed answers by bucket, opened."""
    opened = zstandard.ZstdDecompressor()
    return {k: opened.decompress(v) for k, v in got.items()}


def answers_for(hashes: np.ndarray, got: dict, buckets: int, kind) -> np.ndarray:
    """The answers of all buckets in the order of the sorted hashes that were sent."""
    out = np.zeros(len(hashes), kind)
    for b, i, j in slices(hashes, buckets):
        out[i:j] = np.frombuffer(got[b], kind)
    return out


def repeated(h: np.ndarray, many: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For exchange(): which hashes come from two blocks, or are marked as repeated within one."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = many.copy()
    out[order[1:][same]] = 1
    out[order[:-1][same]] = 1
    return out


def distinct_by_doc(hashes: np.ndarray, doc: np.ndarray):
    """Sorted distinct hashes, the smallest doc of each, and whether another doc has it too."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(h)]]) - 1
    return h[first], d[first], d[last] != d[first] if len(h) else np.zeros(0, bool)
