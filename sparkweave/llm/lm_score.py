"""Language-model scores by logistic mixing of hashed-context bit predictors.

A block's tokens are read as running text: words in lower case, each followed by a space,
and a newline at the end of a document.  A byte is written in the bits of a Huffman code of
the training text.  For each bit, predictors hash the last 1, 2, 3, 4 and 6 bytes (across
words, up to the start of the document) and the bits so far into tables of bit counts; their
stretched probabilities are combined by weights, and the gate that picks the weights knows
how long a context has been seen and which bit of the byte it is.  Weights are learned
online along the training text, every occurrence predicted from all others read so far.
A bit depends on the last six bytes alone, so each distinct window of seven bytes is
computed once in a block, and learned once in _LEARN_BYTES of text, with its number of occurrences.

A token's probability in the bits is one of four predictions, mixed by a second gate:
the bits, the word's share of the corpus, the word's share after the word before, and its
share of the document so far.  The gate's weights begin from corpus-wide rates of what
occurs elsewhere and are refined along each document by how well each prediction has done.
The last three leave the scored document's own text out of the training counts.

Counts of words and of word pairs are exact, corpus-wide and grow with it: blocks send
hashes with counts, buckets add them up.  Tables of bits have a size fixed by the training
bytes, up to MOST_BITS; tasks count their blocks, and tables are added up by parts.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B

ORDERS = (1, 2, 3, 4, 6)
REACH = max(ORDERS)
#: Tables have at most so many slots for each order (as a power of two), so that what is broadcast has a bound.
MOST_BITS = 20
GATES = (len(ORDERS) + 1) * 4
END, START = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0x2545F4914F6CDD1D)
_STRIDE = np.uint32(0x9E3779B1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PARTS, _FAN = 64, 64
_FACTORS = 32  # of up to 1 + exp(12) each, so that their product is far from overflow
_AT_ONCE = 1 << 13  # windows whose bits are worked on together: their matrices stay in a core's cache, and weights move as often in large groups
_LEARN_BYTES = 8 << 20  # of training text that a task's windows are gathered from before they are counted


class Code:
    """A Huffman code of bytes: the tree's node and the bit of each step, laid out byte by byte."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, i, i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[2]], up[b[2]] = (node, 0), (node, 1)
            heapq.heappush(heap, (a[0] + b[0], node, node))
        nodes, bits, self.size = [], [], np.zeros(256, np.int64)
        for byte in range(256):
            path, x = [], byte
            while x in up:
                path.append(up[x])
                x = up[x][0]
            self.size[byte] = len(path)
            nodes += [n - 256 for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
        self.node, self.bit = np.array(nodes, np.uint32), np.array(bits, np.uint8)
        self.first = np.cumsum(self.size) - self.size

    def span(self, byte: int) -> tuple[int, int]:
        return int(self.first[byte]), int(self.first[byte] + self.size[byte])


class Running:
    """Tokens as running text: of the documents in `which` the distinct windows of REACH + 1 bytes and how often each occurs."""

    def __init__(self, block: B.Block, which: np.ndarray | None = None, places: bool = False):
        if places:
            self.window, self.times, self.place = placed(running_windows(block, which))
        else:
            self._count(running_windows(block, which))

    @classmethod
    def of_windows(cls, windows: np.ndarray) -> Running:
        """From all windows of several blocks, which are sorted in place."""
        out = cls.__new__(cls)
        out._count(windows)
        return out

    def _count(self, windows: np.ndarray) -> None:
        windows.sort()
        new = _begins(windows)
        self.window, self.times = windows[new], np.diff(new, append=len(windows)).astype(float)

    @property
    def of(self) -> np.ndarray:
        """The number of the distinct window at each place of the text."""
        return self.at_places(np.arange(len(self.window)))

    def at_places(self, values: np.ndarray) -> np.ndarray:
        """A value of each distinct window, at all its places in the text."""
        out = np.empty(len(self.place), values.dtype)
        out[self.place] = np.repeat(values, self.times)
        return out


def running_windows(block: B.Block, which: np.ndarray | None = None) -> np.ndarray:
    """The windows of a block's running text, one for each of its bytes (of the documents in `which`)."""
    space = B.SPACE[block.data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    kept = np.add.reduceat(keep, block.starts, dtype=np.int64) if len(block.starts) else np.zeros(0, np.int64)
    size = kept + 1
    pads = np.zeros(int(size.sum()) + REACH * len(kept), bool)  # newlines before each document
    at = np.cumsum(size + REACH) - size
    for k in range(1, REACH + 1):
        pads[at - k] = True
    ends = np.zeros(len(pads), bool)
    ends[at + kept] = True
    text = np.full(len(pads), 10, np.uint8)
    text[~(pads | ends)] = np.where(space, 32, B.LOWER[block.data])[keep]
    scored = ~pads[REACH:]
    if which is not None:
        scored &= np.repeat(which, size + REACH)[REACH:]
    return _sevens(text)[scored]


def _begins(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def placed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows in order, how often each occurs, and the places of the first, the second and so on.

    Pairs of bytes are numbered in order; where the numbers and the place fit into 64 bits,
    sorting those takes a third of the time of an argsort, with the same result.
    """
    bits = max(1, len(windows) - 1).bit_length()
    pairs = [(windows >> np.uint64(8 * k)).astype(np.uint16) for k in (REACH - 1, REACH - 3, REACH - 5)]
    pairs.append((windows.astype(np.uint8)).astype(np.uint16))
    key, kinds = np.zeros(len(windows), np.uint64), 1
    for x in pairs:
        there = np.bincount(x, minlength=1 << 16) > 0
        kinds *= int(there.sum())
        key *= np.uint64(there.sum())
        key += (np.cumsum(there) - 1).astype(np.uint64)[x]
    if kinds << bits <= 1 << 64:
        key <<= np.uint64(bits)
        key |= np.arange(len(windows), dtype=np.uint64)
        key.sort()
        place = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        key >>= np.uint64(bits)
        new = _begins(key)
        window = windows[place[new]]
    else:
        place = np.argsort(windows, kind="stable")
        known = windows[place]
        new = _begins(known)
        window = known[new]
    return window, np.diff(new, append=len(windows)), place


class Last:
    """Sorted windows that end in the same byte: each has the bits of that byte, so bits are matrices, window by step."""

    def __init__(self, code: Code, window: np.ndarray, same: np.ndarray, table_bits: int):
        at = slice(*code.span(int(window[0] >> np.uint64(8 * REACH))))
        self.window, self.same, self.shift = window, same, np.uint32(32 - table_bits)
        self.bit, self.path = code.bit[at], code.node[at] * _STRIDE
        self.step = np.minimum(np.arange(len(self.bit)), 3)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a new run of the last k + 1 bytes begins, and the slots of each run's bits in the table of order k."""
        new = np.flatnonzero(self.same <= k) if k < REACH else np.arange(len(self.window))
        before = (self.window[new] << np.uint64(64 - 8 * REACH)) >> np.uint64(64 - 8 * k)  # the last k bytes
        context = (B.mix(before + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)
        return new, (context[:, None] + self.path) >> self.shift

    def spread(self, new: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A row for each window from one for each run."""
        if len(rows) == len(self.window):
            return rows
        size = np.empty_like(new)
        np.subtract(new[1:], new[:-1], out=size[:-1])
        size[-1] = len(self.window) - new[-1]
        return np.repeat(rows, size, axis=0)


def by_last_byte(code: Code, window: np.ndarray, table_bits: int):
    """(slice, its windows as Last) for each last byte among sorted windows, _AT_ONCE windows at most."""
    cut = np.searchsorted(window, np.arange(257, dtype=np.uint64) << np.uint64(8 * REACH))
    same, other = np.zeros(len(window), np.uint8), window[1:] ^ window[:-1]
    for k in range(1, REACH + 1):  # how many of the last bytes are those of the window before
        same[1:] += other < np.uint64(1 << 8 * (REACH + 1 - k))
    for first, end in zip(cut[:-1].tolist(), cut[1:].tolist()):
        for i in range(first, end, _AT_ONCE):
            j = min(i + _AT_ONCE, end)
            same[i] = 0  # runs begin anew
            yield slice(i, j), Last(code, window[i:j], same[i:j], table_bits)


def running_bytes(block: B.Block, which: np.ndarray) -> np.ndarray:
    """How often each byte occurs in the running text of these documents."""
    on = np.repeat(which, block.lens + 1)
    ink = ~B.SPACE[block.data]
    n = np.bincount(B.LOWER[block.data[on & ink]], minlength=256)
    n[32] += (on[1:] & ink[:-1] & ~ink[1:]).sum()
    n[10] += which.sum()
    return n


def _sevens(text: np.ndarray) -> np.ndarray:
    """Each run of seven bytes as one integer, the last byte highest."""
    out = np.zeros(len(text) - REACH, np.uint64)
    for k in range(REACH, -1, -1):
        out <<= np.uint64(8)
        out |= text[k : len(text) - REACH + k]
    return out


def stretch(n0, n1):
    """The logit of the bit after these counts; exactly 0 only where the context is new."""
    out = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
    return np.where((out == 0) & (n0 + n1 > 0), np.float32(1e-4), out)


def gates(inputs: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    level = np.zeros(inputs[0].shape, np.uint8)
    for k, x in enumerate(inputs):
        np.maximum(level, (x != 0) * np.uint8(k + 1), out=level)
    return level.astype(np.intp) * 4 + step


def mixed(inputs: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    dot = np.zeros(gate.shape, np.float32)
    for x, w in zip(inputs, weights.astype(np.float32)):
        dot += x * w[gate]
    return np.clip(dot, -12, 12, out=dot)


class Learner:
    """Bit counts and weights of a task, refined block by block."""

    def __init__(self, code: Code, table_bits: int):
        self.code, self.table_bits = code, table_bits
        self.counts = np.zeros((len(ORDERS), 2 << table_bits), np.int32)
        self.weights, self.seen, self.steps = np.full((len(ORDERS), GATES), 0.3), 0.0, 0
        self.pull, self.total, self.due = np.zeros((len(ORDERS), GATES)), np.zeros(GATES), 0

    def add(self, text: Running, rate: float = 0.1) -> None:
        """Count all windows; then each moves the weights, every occurrence predicted from all others so far."""
        found, times = [], text.times.astype(np.int32)
        for part, last in by_last_byte(self.code, text.window, self.table_bits):
            runs = [last.runs(order) for order in ORDERS]
            for counts, (new, slots) in zip(self.counts, runs):
                at = (slots << np.uint32(1)) | last.bit
                np.add.at(counts, at.ravel(), np.repeat(np.add.reduceat(times[part], new, dtype=np.int32), at.shape[1]))
            found.append((part, last, runs))
        for k in np.random.default_rng(len(found)).permutation(len(found)):  # not byte by byte, which would leave the weights at the last bytes
            part, last, runs = found[k]
            inputs, one = [], last.bit.astype(np.int32)
            for counts, (new, slots) in zip(self.counts, runs):
                n = counts.view(np.int64)[slots].view(np.int32).reshape(*slots.shape, 2)  # both counts of a slot at once
                inputs.append(last.spread(new, stretch((n[..., 0] - 1 + one).astype(np.float32), (n[..., 1] - one).astype(np.float32))))
            gate, n = gates(inputs, last.step), np.repeat(text.times[part], len(one))
            error = (one - 1 / (1 + np.exp(-mixed(inputs, gate, self.weights)))).ravel() * n
            gate = gate.ravel()
            self.total += np.bincount(gate, n, GATES)
            for k, x in enumerate(inputs):
                self.pull[k] += np.bincount(gate, error * x.ravel(), GATES)
            self.due += error.size
            if self.due >= 1 << 15:
                self.move(rate)
        self.move(rate)

    def move(self, rate: float) -> None:
        self.weights += rate / np.sqrt(1 + self.steps / 30) * self.pull / np.maximum(self.total, 1)
        self.steps, self.seen, self.due = self.steps + 1, self.seen + float(self.total.sum()), 0
        self.pull[:], self.total[:] = 0, 0


class Model:
    """The tables and weights, with what every bit looks up computed once per slot."""

    def __init__(self, code: Code, counts: np.ndarray, weights: np.ndarray):
        pairs = counts.reshape(len(ORDERS), -1, 2)
        self.code, self.weights, self.table_bits = code, weights, int(pairs.shape[1]).bit_length() - 1
        self.stretched = [stretch(x[:, 0].astype(np.float32), x[:, 1].astype(np.float32)) for x in pairs]

    def log2_windows(self, text: Running) -> np.ndarray:
        """log2 of the probability of the last byte of each window, after the bytes before it."""
        out = np.zeros(len(text.window))
        for part, last in by_last_byte(self.code, text.window, self.table_bits):
            inputs = []
            for order, table in zip(ORDERS, self.stretched):
                new, slots = last.runs(order)
                inputs.append(last.spread(new, table[slots]))
            dot = mixed(inputs, gates(inputs, last.step), self.weights)
            dot *= np.where(last.bit, np.float32(-1), np.float32(1))  # a one has probability 1 / (1 + exp(-dot))
            odds = 1 + np.exp(dot).astype(np.float64)
            for k in range(0, odds.shape[1], _FACTORS):
                out[part] -= np.log2(odds[:, k : k + _FACTORS].prod(axis=1))
        return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the place of each entry among them."""
    order = np.argsort(h)
    known, new = h[order], np.ones(len(h), bool)
    np.not_equal(known[1:], known[:-1], out=new[1:])
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return known[new], at


class Tokens:
    """The tokens of a block (lower-cased words, an end for each document) and its pairs, as distinct hashes."""

    def __init__(self, block: B.Block):
        w = self.words = block.words(lower=True)
        self.n = w.last - w.first + 1
        self.start = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(block.ids)), self.n)
        hashes = np.insert(w.hash, w.last, END)
        self.sizes = np.insert(w.ends - w.starts + 1, w.last, 1)  # bytes of running text
        self.hash, self.at = distinct(hashes)
        before = np.concatenate([[START], hashes[:-1]])[: len(hashes)]
        before[self.start] = START
        self.pair, self.pair_at = distinct(B.mix(before * _GOLD + hashes) >> np.uint64(16) << np.uint64(16))
        self.held = self.held_out(block)

    @staticmethod
    def held_out(block: B.Block) -> np.ndarray:
        return np.array([zlib.crc32(b"" if i == B.NULL_ID else str(i).encode()) % 10 == 0 for i in block.ids.tolist()], bool)

    def counts(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at[~self.held[self.doc]], minlength=size)

    def in_document(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each entry occurs in its document, if that is trained on, and how often it has before."""
        key = self.doc * (int(at.max(initial=0)) + 1) + at
        bits, most = max(1, len(key) - 1).bit_length(), int(key.max(initial=0))
        if most < 1 << 63 - bits:  # sorted with its place; an argsort takes several times as long
            key = (key << bits) | np.arange(len(key))
            key.sort()
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(new, append=len(key))
        own, earlier = np.empty((2, len(key)), np.int64)
        own[order] = np.repeat(times, times)
        earlier[order] = np.arange(len(key)) - np.repeat(new, times)
        return np.where(self.held[self.doc], 0, own), earlier


@functools.cache
def _press() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _opened() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """Integers of a sorted run of hashes or of counts, as compressed planes of bytes."""
    return _press().compress(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(_opened().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _sent(block: int, kind: int, hashes: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """(bucket, block, hashes, values) rows of sorted hashes and their counts; pairs follow the buckets of words."""
    return [(b + kind * buckets, block, _packed(np.diff(hashes[i:j], prepend=np.uint64(0))), _packed(values[i:j])) for b, i, j in B.slices(hashes, buckets)]


def _added(table: pa.Table) -> pa.Table:
    """Per bucket: twice the corpus-wide count of each entry, plus one for the block that answers for it, and sums of those."""
    hs = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("h").to_pylist()]
    n = np.concatenate([_unpacked(x) for x in table.column("v").to_pylist()]).astype(np.int64)
    _, first, at = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
    total = np.bincount(at, n, minlength=len(first)).astype(np.int64)
    own = np.zeros(len(n), np.int64)
    own[first] = 1
    cut = np.cumsum([0, *map(len, hs)])
    rows = [(total[at[i:j]], own[i:j]) for i, j in zip(cut[:-1], cut[1:])]
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"), "r": pa.array([_packed(t) for t, _ in rows], pa.binary()),
        "kinds": pa.array([int(o[t > 0].sum()) for t, o in rows], pa.int64()), "total": pa.array([int((t * o).sum()) for t, o in rows], pa.int64()),
        "once": pa.array([int(o[t == 1].sum()) for t, o in rows], pa.int64()),
    })


_COUNTS = "part int, task long, counts binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _summed(rows: list[bytes], size: int) -> np.ndarray:
    """The sum of compressed counts, of 32 bits from a task and of 64 from sums of tasks."""
    total = np.zeros(size, np.int64)
    for x in rows:
        raw = zstandard.ZstdDecompressor().decompress(x)
        total += np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64)
    return total


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, all divided by one power of two where the largest asks for it; a count stays at least 1."""
    shift = max(0, int(counts.max(initial=0)).bit_length() - 31)
    return np.maximum(counts >> shift, counts > 0).astype(np.int32)


def _bit_tables(blocks: DataFrame, code: Code, table_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit counts and weights over all training documents: each task counts its blocks; tables meet part by part, _FAN tasks at a time."""

    def learn(batches):
        own, gathered = Learner(code, table_bits), []

        def add_up():
            if gathered:
                windows = np.concatenate(gathered)
                gathered.clear()
                own.add(Running.of_windows(windows))

        for batch in batches:
            for k in range(batch.num_rows):
                _, block = B.first_block(pa.Table.from_batches([batch.slice(k, 1)]))
                gathered.append(running_windows(block, ~Tokens.held_out(block)))
                if sum(map(len, gathered)) >= _LEARN_BYTES:
                    add_up()
        add_up()
        press = zstandard.ZstdCompressor(level=1)
        parts = [press.compress(np.ascontiguousarray(x).tobytes()) for x in np.split(own.counts, _PARTS, axis=1)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(-1, _PARTS), pa.int32()), "task": pa.array([task] * (_PARTS + 1), pa.int64()),
            "counts": pa.array([np.append(own.weights.ravel() * own.seen, own.seen).tobytes(), *parts], pa.binary()),
        })

    def add(table: pa.Table) -> pa.Table:
        rows, part = table.column("counts").to_pylist(), table.column("part")[0].as_py()
        if part < 0:
            total = np.sum([np.frombuffer(x) for x in rows], axis=0).tobytes()
        else:
            total = zstandard.ZstdCompressor(level=1).compress(_summed(rows, len(ORDERS) * (2 << table_bits) // _PARTS).tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "task": pa.array([table.column("task")[0].as_py() // _FAN], pa.int64()), "counts": pa.array([total], pa.binary())})

    tables = blocks.mapInArrow(learn, _COUNTS).checkpoint()
    tasks = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tables = tables.groupBy("part", F.floor(F.col("task") / _FAN).alias("fan")).applyInArrow(add, _COUNTS).checkpoint()
        tasks = -(-tasks // _FAN)
    got = {r["part"]: bytes(r["counts"]) for r in tables.collect()}  # of a size fixed by MOST_BITS
    if not got:
        return np.zeros((len(ORDERS), 2 << table_bits), np.int32), np.full((len(ORDERS), GATES), 0.3)
    size = len(ORDERS) * (2 << table_bits) // _PARTS
    counts = _scaled(np.concatenate([_summed([got[k]], size).reshape(len(ORDERS), -1) for k in range(_PARTS)], axis=1))
    sums = np.frombuffer(got[-1])
    return counts, (sums[:-1] / sums[-1] if sums[-1] else np.full(sums.size - 1, 0.3)).reshape(len(ORDERS), GATES)


def score_documents(docs: DataFrame, echo: float = 0.25, prior: float = 20.0) -> DataFrame:
    """Scores of each whole text by a model learned from those whose crc32(doc_id) mod 10 is not 0.

    Returns one row per row of docs: doc_id, held_out, n_tokens (words and one end), n_known
    (seen in training), train_tokens (of the whole corpus), base_score (add-0.1 unigram), score
    (log10 probability under the mixing model), bits_per_byte.  echo: how far the document's
    own past may be trusted at first; prior: so many tokens the gate's first weights count for.
    Null text is empty; a null doc_id counts as the empty text, so as held out; repeated rows
    count and score each; without training documents nothing is known.  Other columns are ignored.
    """
    blocks = B.pack(docs, block_bytes=2 << 20)
    buckets = B.buckets_for(blocks, share=0.3)

    def send(number, block):
        t = Tokens(block)
        rows = _sent(number, 0, t.hash, t.counts(t.at, len(t.hash)), buckets) + _sent(number, 1, t.pair, t.counts(t.pair_at, len(t.pair)), buckets)
        return pa.RecordBatch.from_pydict({c: pa.array(x, kind) for c, kind, x in zip(("bucket", "block", "h", "v"), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), zip(*rows))})

    answers = B.each_block(blocks, send, B.SENT_SCHEMA).groupBy("bucket").applyInArrow(_added, B.BACK_SCHEMA + ", kinds long, total long, once long").checkpoint()
    sums = {r["pairs"]: r for r in answers.groupBy((F.col("bucket") >= buckets).alias("pairs")).agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"), F.sum("once").alias("once")).collect()}
    total, kinds = (sums[False]["total"], sums[False]["kinds"]) if sums else (0, 0)
    known_words, known_pairs = (1 - sums[k]["once"] / sums[k]["total"] if sums and sums[k]["total"] else 0.0 for k in (False, True))

    def histogram(number, block):
        n = running_bytes(block, ~Tokens.held_out(block))
        return pa.RecordBatch.from_pydict({"byte": np.arange(256), "n": n})

    counted = dict(B.each_block(blocks, histogram, "byte long, n long").groupBy("byte").agg(F.sum("n")).collect())
    counted = np.array([counted.get(i, 0) for i in range(256)])
    code = Code(counted)
    table_bits = int(np.clip(np.log2(max(1, counted.sum())), 14, MOST_BITS))
    counts, weights = _bit_tables(blocks, code, table_bits)
    tables = docs.sparkSession.sparkContext.broadcast(counts)
    ready: list[Model] = []  # one for each worker process

    def score(number, block, got):
        if not ready:
            ready.append(Model(code, tables.value, weights))
        t, text = Tokens(block), Running(block, places=True)
        told = {k: _unpacked(x).astype(np.int64) for k, x in got.items()}
        c = _answers(t.hash, told, buckets, 0)
        pairs = _answers(t.pair, told, buckets, 1)[t.pair_at]
        ends = int(c[np.searchsorted(t.hash, END)]) if len(t.hash) else 0
        base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))

        bits = np.add.reduceat(text.at_places(ready[0].log2_windows(text)), np.cumsum(t.sizes) - t.sizes)
        place = np.arange(len(t.at)) - np.repeat(t.start, t.n)
        (own, earlier), known = t.in_document(t.at), c[t.at]
        before = np.concatenate([[0], (known - own)[:-1]])[: len(known)]  # how often the word before occurs elsewhere
        before[t.start] = ends - ~t.held
        size = np.where(t.held, 0, t.n)[t.doc]
        p = np.stack([
            np.exp2(np.maximum(bits, -1000)),
            (known - own) / np.maximum(total - size, 1),
            (pairs - t.in_document(t.pair_at)[0]) / np.maximum(before, 1),
            earlier / np.maximum(place, 1),
        ])
        log = along_documents(p, before, place, t, known_words, known_pairs, echo, prior, bits)
        by_doc = lambda x: np.bincount(t.doc, x, minlength=len(block.ids))
        score = by_doc(log)
        return pa.table({
            "doc_id": B.ids_out(block.ids), "held_out": t.held, "n_tokens": t.n, "n_known": by_doc(known > 0).astype(np.int64),
            "train_tokens": np.full(len(t.n), total, np.int64), "base_score": by_doc(base[t.at]), "score": score,
            "bits_per_byte": -score * np.log2(10) / (block.lens + 1),
        })

    return B.per_block(blocks, answers, score, SCHEMA)


def along_documents(p, before, place, t, known_words, known_pairs, echo, prior, bits) -> np.ndarray:
    """log10 of each token's probability: predictions p (4, tokens) mixed by weights that follow the document.

    First weights: what occurs elsewhere, of all pairs and of all words, is how far pairs and
    words are trusted.  Each prediction's weight then goes by the tokens it has been
    responsible for so far in the document, against what it was given.
    """
    pair = known_pairs * before / (before + 4.0)
    past = (1 - pair) * echo * place / (place + 25.0)
    rest = 1 - pair - past
    first = np.stack([rest * (1 - 0.9 * known_words), rest * 0.9 * known_words, pair, past])
    share = first * p
    share /= np.maximum(share.sum(axis=0), 1e-300)
    weight = np.empty_like(first)
    for k in range(len(p)):
        got, due = (np.concatenate([[0.0], np.cumsum(x)]) for x in (share[k], first[k]))
        done = lambda s: s[:-1] - np.repeat(s[t.start], t.n)  # noqa: E731  before this token, in its document
        weight[k] = first[k] * (prior * 0.1 + done(got)) / (prior * 0.1 + done(due))
    weight /= weight.sum(axis=0)
    mixed_p = (weight * p).sum(axis=0)
    spelled = np.log10(weight[0]) + bits * np.log10(2)
    return np.where(mixed_p > 1e-290, np.log10(np.maximum(mixed_p, 1e-300)), spelled)


def _answers(hashes: np.ndarray, told: dict, buckets: int, kind: int) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    for b, i, j in B.slices(hashes, buckets):
        out[i:j] = told[b + kind * buckets]
    return out
