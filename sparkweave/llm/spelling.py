"""Spelling variants: words one edit apart, and the form that each word stands for.

A word count over whole texts gives the vocabulary.  A Bloom filter over it is sharded by word
length and cut into blocks of one cache line; the filter of a pass has at most `pass_bytes`, so a
larger vocabulary takes more passes over the same path and the broadcast stays bounded.  Each word
generates its neighbourhood as hashes, in constant time each from prefix sums: every deletion, and
every replacement by a larger letter (insertions and the other replacements are the same pairs seen
from the other word).  Only what the filter knows becomes a string and is shuffled, to an exact
join with the vocabulary that removes false positives.  Forms are followed to their last by pointer
doubling; a form occurs at least twice as often as its word, so chains are short and without cycles.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B

#: A word is a maximal run of A-Z, a-z, U+00C0 to U+00FF; in UTF-8 the latter are 0xC3 and one more byte.
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LEAD = 0xC3
#: Filters: 512 bits a block, 7 probes of 9 bits each, segments of 2^13 blocks (512 KB).
BLOCK_BITS, PROBES, SEGMENT = 512, 7, 13
#: Bits a key; long words are few and generate more, so they get more.
BITS, LONG, LONG_BITS = 16, 64, 64
PASS_BYTES = 64 << 20
#: Positions whose edits are generated at once.
CHUNK = 1 << 13

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


def crc32_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start : start + size], each continued from the checksum `before`."""
    out = ~before.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    s, n, crc = start[order], size[order], out[order]
    for k in range(min(int(n[0]), LONG) if len(n) else 0):
        some = int(np.searchsorted(-n, -k))  # the first of the order are longer than k
        crc[:some] = _CRC[(crc[:some] ^ data[s[:some] + k]) & 0xFF] ^ (crc[:some] >> 8)
    crc = ~crc
    for i in range(int(np.searchsorted(-n, -LONG))):
        at = int(s[i]) + LONG
        crc[i] = zlib.crc32(data[at : at + int(n[i]) - LONG].tobytes(), int(crc[i]))
    out[order] = crc
    return out


def block_words(block: B.Block, ids: list[bytes], drop_every: int, min_chars: int) -> tuple[list[bytes], list[int]]:
    """The distinct words of a block, in UTF-8, and their numbers; ids: the doc_id of each document as text."""
    data = block.data
    lead = data == _LEAD
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # a block ends with a newline
    if not len(start):
        return [], []
    low = B.LOWER[data]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    doc = np.searchsorted(block.starts, start, side="right") - 1
    body = low.tobytes()
    hit = np.zeros(len(start), bool)
    found: dict[bytes, int] = {}
    if drop_every:
        before = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)
        crc = crc32_of(low, start, end - start, before[doc])
        hit = crc % np.uint32(drop_every) == 0
        at = np.flatnonzero(hit)
        for a, b, n, h in zip(start[at].tolist(), end[at].tolist(), chars[at].tolist(), crc[at].tolist()):
            if n > min_chars:
                word = body[a:b].decode()
                k = h % n
                word = (word[:k] + word[k + 1 :]).encode()
                found[word] = found.get(word, 0) + 1
    at = np.flatnonzero(~hit & (chars >= min_chars))
    start, end = start[at], end[at]
    _, first, n = np.unique(B.Rolling(B.BYTE[low]).at(start, end), return_index=True, return_counts=True)
    for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
        word = body[a:b]
        found[word] = found.get(word, 0) + k
    return list(found), list(found.values())


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, drop_every: int = 0) -> DataFrame:
    """(word, n): words of at least min_chars code points that occur at least min_count times.

    drop_every: a run whose crc32 of `<doc_id>:<run>` it divides loses the code point at that
    crc32 modulo its length (planted misspellings); 0 for none.
    """

    def run(batches):
        for batch in batches:
            for part, block in B.in_blocks(batch, "t", 4 << 20):
                words, n = block_words(block, B.text_bytes(part.column(0)), drop_every, min_chars)
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})

    cols = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("t"))
    return cols.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Words:
    """A batch of words one after another, a byte a code point, with prefix sums of their hashes."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in raw], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.body = b"".join(raw)
        self.data = np.frombuffer(self.body, np.uint8)
        rolling = B.Rolling(B.BYTE[self.data])
        self.sums, self.inv = rolling.sums, rolling.inv
        self.power = B.powers(len(self.data) + 1)[0]
        self.whole = self.sums[self.end] - self.sums[self.start]

    def keys(self) -> np.ndarray:
        return B.mix(self.whole * self.inv[self.start])

    def edits(self, alphabet: np.ndarray):
        """Chunks of (key, length, word, position, letter): letter -1 deletes the position's."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        for lo in range(0, len(self.data), CHUNK):
            at = np.arange(lo, min(lo + CHUNK, len(self.data)))
            w, s = word[at], self.start[word[at]]
            # of equal letters in a row only the first goes
            first = (at == s) | (self.data[at] != self.data[np.maximum(at - 1, 0)])
            i, wi, si = at[first], w[first], s[first]
            rest = (self.sums[self.end[wi]] - self.sums[i + 1]) * self.inv[1] + self.sums[i] - self.sums[si]
            yield B.mix(rest * self.inv[si]), self.size[wi] - 1, wi, i, np.full(len(i), -1, np.int64)
            row, col = np.nonzero(alphabet[None, :] > self.data[at][:, None])
            i, c = at[row], alphabet[col]
            changed = self.whole[w[row]] + (B.BYTE[c] - B.BYTE[self.data[i]]) * self.power[i]
            yield B.mix(changed * self.inv[s[row]]), self.size[w[row]], w[row], i, c.astype(np.int64)

    def edited(self, word: int, at: int, letter: int) -> str:
        a, b = int(self.start[word]), int(self.end[word])
        return (self.body[a:at] + (b"" if letter < 0 else bytes([letter])) + self.body[at + 1 : b]).decode("latin-1")


class Shards:
    """Where the keys of each word length lie: their first block and number of blocks."""

    def __init__(self, counts: dict[int, int]):
        self.sizes = np.array(sorted(counts), np.int64)
        n = np.array([counts[int(s)] for s in self.sizes], np.int64)
        blocks = -(-n * np.where(self.sizes > LONG, LONG_BITS, BITS) // BLOCK_BITS)
        self.blocks, self.total = blocks.astype(np.uint64), int(blocks.sum())
        self.first = (np.cumsum(blocks) - blocks).astype(np.uint64)

    @property
    def segments(self) -> int:
        return -(-self.total >> SEGMENT)

    def block(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The block of each key; -1 where no word has that length."""
        k = np.minimum(np.searchsorted(self.sizes, size), len(self.sizes) - 1)
        at = self.first[k] + (((key >> np.uint64(32)) * self.blocks[k]) >> np.uint64(32))
        return np.where(self.sizes[k] == size, at.astype(np.int64), -1)


def _bit(low: np.ndarray, probe: int) -> np.ndarray:
    return ((low >> np.uint64(9 * probe)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def known(bits: np.ndarray, block: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of these keys the blocks know, as indices; each probe looks only at what is left."""
    left = np.flatnonzero((block >= 0) & (block < len(bits) * 8 // BLOCK_BITS))
    low = B.mix(key[left])
    for p in range(PROBES):
        b = _bit(low, p)
        ok = (bits[block[left] * (BLOCK_BITS // 8) + (b >> 3)] >> (b & 7).astype(np.uint8) & 1).astype(bool)
        left, low = left[ok], low[ok]
    return left


def _filters(vocab: DataFrame, shards: Shards, first: int, last: int) -> np.ndarray:
    """The bits of the segments first to last - 1, each made in one task from its keys."""

    def place(batches):
        for batch in batches:
            words = Words(batch.column(0).to_pylist())
            key = words.keys()
            block = shards.block(key, words.size)
            yield pa.RecordBatch.from_pydict({"segment": pa.array(block >> SEGMENT, pa.int64()), "block": pa.array(block & (1 << SEGMENT) - 1, pa.int64()), "key": pa.array(key.view(np.int64))})

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS // 8 << SEGMENT, np.uint8)
        block = table.column("block").to_numpy()
        low = B.mix(table.column("key").to_numpy().view(np.uint64))
        for p in range(PROBES):
            b = _bit(low, p)
            np.bitwise_or.at(bits, block * (BLOCK_BITS // 8) + (b >> 3), (1 << (b & 7)).astype(np.uint8))
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    keys = vocab.select("word").mapInArrow(place, "segment long, block long, key long").filter(F.col("segment").between(first, last - 1))
    out = np.zeros((last - first, BLOCK_BITS // 8 << SEGMENT), np.uint8)
    for r in keys.groupBy("segment").applyInArrow(fill, "segment long, bits binary").toLocalIterator():  # pass_bytes at most
        out[r["segment"] - first] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def near_words(vocab: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, near, near_n): each pair of vocabulary words one edit apart, once."""
    spark = vocab.sparkSession
    shards = Shards({r["size"]: r["count"] for r in vocab.groupBy(F.length("word").alias("size")).count().collect()})  # one row a word length
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    each = max(1, pass_bytes // (BLOCK_BITS // 8 << SEGMENT))
    out = spark.createDataFrame([], "word string, n long, near string")
    for first in range(0, shards.segments, each):
        sent = spark.sparkContext.broadcast(_filters(vocab, shards, first, min(first + each, shards.segments)))

        def probe(batches, sent=sent, below=first << SEGMENT):
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                flat = Words(words)
                of, at, letter = [], [], []
                for key, size, w, i, c in flat.edits(alphabet):
                    hit = known(sent.value, shards.block(key, size) - below, key)
                    of.append(w[hit]), at.append(i[hit]), letter.append(c[hit])
                of = np.concatenate(of) if of else np.zeros(0, np.int64)
                near = [flat.edited(*x) for x in zip(of.tolist(), np.concatenate(at).tolist(), np.concatenate(letter).tolist())] if len(of) else []
                yield pa.RecordBatch.from_pydict({"word": pa.array([words[k] for k in of], pa.string()), "n": pa.array(n[of], pa.int64()), "near": pa.array(near, pa.string())})

        found = vocab.select("word", "n").mapInArrow(probe, "word string, n long, near string").checkpoint()
        sent.destroy()
        out = found if first == 0 else out.unionByName(found)
    return out.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) from links(word, form): forms followed to the last, by pointer doubling; done words wait."""
    now = links.select("word", F.col("form").alias("root"), F.lit(False).alias("done")).checkpoint()
    while not now.filter("not done").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("ended"))
        step = now.filter("not done").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("ended", F.lit(True)).alias("done"))
        now = now.filter("done").unionByName(step).checkpoint()
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, drop_every: int = 0, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of docs(doc_id, text); see vocabulary().

    Near: one code point inserted, deleted or replaced.  form: the near word of largest n (ties:
    smallest in code-point order) if that n is at least ratio times the word's, else null.  root: the
    last of the forms that follow from the word, itself if it has none.  A null text has no words, a
    null doc_id is written as an empty text; repeated rows count each.  Runs of any length are words.
    """
    B.prepare(docs.sparkSession)
    vocab = vocabulary(docs, min_chars, min_count, drop_every).checkpoint()
    pairs = near_words(vocab, pass_bytes)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n" if b == "near" else "n")).alias("less"), F.col(b).alias("near")).alias("best"))
    both = pairs.select(F.explode(F.array(side("word", "near"), side("near", "word"))).alias("x")).select("x.word", "x.best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    out = vocab.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n").checkpoint()
    roots = last_forms(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
