"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distances.

Texts are token sequences (runs of letters and digits, A-Z lower-cased).  A document
leaks an item if a passage of it is within k = floor(max_edits * tokens of the item) token
edits.  Such a passage holds one of k + 1 disjoint pieces of the item unchanged, so windows
of the item's size that align with a shared piece are the only ones to look at.

The random-walk embedding of Chakraborty, Goldenberg and Koucky reads a window with
pauses: at each of 3 L steps it writes the current token, and the pair (step, token) draws
whether to move on.  Two sequences that share the random draws fall into step again after
an edit, so edit distance becomes Hamming distance.  Each table of the LSH samples a few
steps of one embedding; a window and an item meet in a table if all its samples agree.
As many tables are drawn as seeded edits of the items, of each kind, need for the target recall.  Pairs
that meet are verified by exact edit distance.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B

GAPS = np.array([not (chr(c).isalnum() and c < 128 or c >= 128) for c in range(256)])
SAMPLES, EMBEDDINGS, MOST_TABLES = 3, 8, 512
_PAD = np.uint64(0)


def embed(tokens: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """The CGK walk of each row (padded token hashes) over 3 * columns steps; a walk past the end writes the pad."""
    n, width = tokens.shape
    padded = np.concatenate([tokens, np.zeros((n, 1), np.uint64)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, 3 * width), np.uint64)
    for t in range(3 * width):
        now = padded[rows, np.minimum(at, lens)]
        out[:, t] = np.where(at < lens, now, _PAD)
        draw = B.mix(now ^ B.mix(np.array([seed * 100_003 + t + 1], np.uint64)))
        at = at + (draw & np.uint64(1)).astype(np.int64)
    return out


class Tables:
    """The LSH: tables[i] = (embedding, steps as shares of 3 L)."""

    def __init__(self, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.spots = rng.random((count, SAMPLES))
        self.seeds = [seed * EMBEDDINGS + e for e in range(EMBEDDINGS)]

    def keys(self, tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """(rows, tables) of hashes."""
        walks = [embed(tokens, lens, s) for s in self.seeds[: min(EMBEDDINGS, len(self.spots))]]
        steps = (self.spots[None, :, :] * (3 * lens)[:, None, None]).astype(np.int64)
        rows = np.arange(len(tokens))
        out = np.zeros((len(tokens), len(self.spots)), np.uint64)
        for i in range(len(self.spots)):
            h = np.full(len(tokens), i + 1, np.uint64)
            for s in range(SAMPLES):
                h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + walks[i % EMBEDDINGS][rows, steps[:, i, s]])
            out[:, i] = h
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in rows], np.int64)
    out = np.zeros((len(rows), max([1, *lens])), np.uint64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out, lens


KINDS_OF_EDITS = ("swap", "delete", "insert", "any")


def edited(x: np.ndarray, edits: int, rng, kind: str = "any") -> np.ndarray:
    """x after so many random token edits of a kind."""
    out = list(x)
    for _ in range(edits):
        now = kind if kind != "any" else KINDS_OF_EDITS[rng.integers(3)]
        i = int(rng.integers(max(1, len(out))))
        new = np.uint64(rng.integers(1, 2**63))
        if now == "swap" and out:
            out[i] = new
        elif now == "delete" and len(out) > 1:
            out.pop(i)
        else:
            out.insert(i, new)
    return np.array(out, np.uint64)


def pieces_of(x: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """(offset, hash) of the edits + 1 disjoint pieces of an item, one of which is intact after so many edits."""
    size = len(x) // (edits + 1)
    at = np.arange(edits + 1) * size
    return list(zip(at.tolist(), B.Rolling(x).at(at, at + size).tolist()))


def tables_for(items: list[np.ndarray], max_edits: float, recall: float, seed: int, trials: int = 500) -> Tables | None:
    """As few tables (a power of two) as find this share of items after the most edits of whichever kind is worst.

    The trials are passages amid other text, with the windows that the search would look at;
    half of the misses that the recall allows are kept as a margin.
    None: MOST_TABLES do not reach it, so all such windows are to be verified.
    """
    rng = np.random.default_rng(seed)
    every = Tables(MOST_TABLES, seed)
    first = np.full(trials * len(KINDS_OF_EDITS), MOST_TABLES)  # the first table that finds each trial
    kinds = np.arange(len(first)) % len(KINDS_OF_EDITS)
    for begin in range(0, len(first), 50):
        rows, whole, trial = [], [], []
        for t in range(begin, min(begin + 50, len(first))):
            x = items[int(rng.integers(len(items)))]
            edits = int(max_edits * len(x))
            around = lambda: rng.integers(1, 2**63, len(x)).astype(np.uint64)  # noqa: B023, E731
            text = np.concatenate([around(), edited(x, edits, rng, KINDS_OF_EDITS[kinds[t]]), around()])
            places: dict[int, list[int]] = defaultdict(list)
            for j, h in enumerate(B.Rolling(text).every(len(x) // (edits + 1)).tolist()):
                places[h].append(j)
            for start in {max(0, j - o) for o, h in pieces_of(x, edits) for j in places.get(h, ())}:
                rows.append(text[start : start + len(x)])
                whole.append(x)
                trial.append(t)
        (a, n), (b, _) = padded(whole), padded(rows)
        b = np.concatenate([b, np.zeros((len(b), a.shape[1] - b.shape[1]), np.uint64)], axis=1)
        meet = every.keys(a, n) == every.keys(b, n)
        np.minimum.at(first, trial, np.where(meet.any(axis=1), meet.argmax(axis=1), MOST_TABLES))
    count = EMBEDDINGS
    while count <= MOST_TABLES:
        if np.min(np.bincount(kinds, first < count) / np.bincount(kinds)) >= (1 + recall) / 2:
            every.spots = every.spots[:count]
            return every
        count *= 2
    return None


def edit_distance_within(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text nearest to item, if at most `most` edits away."""
    text_row = np.array(text, np.uint64)
    n = len(text)
    row = np.zeros(n + 1, np.int64)  # a passage may begin anywhere
    span = np.arange(n + 1)
    for i, x in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text_row != np.uint64(x)), row[1:] + 1)
        row = np.minimum.accumulate(new - span) + span
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


def _tokens(text: str) -> np.ndarray:
    return B.Block.of([0], [text.encode()]).words(lower=True, gaps=GAPS).hash


SCHEMA = "doc_id long, item_id long, edits long, item_tokens long, first_token long"


def _leaks_of(docs: DataFrame, items: list[tuple[int, str]], max_edits: float, recall: float, seed: int) -> DataFrame:
    ids, seqs = [], []
    for i, text in items:
        seq = _tokens(text or "")
        if len(seq):
            ids.append(i)
            seqs.append(seq)
    if not seqs:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    tables = tables_for(seqs, max_edits, recall, seed)
    edits = [int(max_edits * len(x)) for x in seqs]
    pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for i, (x, k) in enumerate(zip(seqs, edits)):
        for offset, h in pieces_of(x, k):
            pieces[len(x) // (k + 1)][h].append((i, offset))
    pieces = {size: dict(x) for size, x in pieces.items()}
    known = {size: np.sort(np.array(list(x), np.uint64)) for size, x in pieces.items()}
    item_keys = tables.keys(*padded(seqs)) if tables else None
    low = np.uint64(0xFFFF)

    def leaks(block):
        words = block.words(lower=True, gaps=GAPS)
        roll = B.Rolling(words.hash)
        starts: set[tuple[int, int, int]] = set()
        for size, hashes in known.items():
            h = roll.every(size)
            sieve = np.zeros(1 << 16, bool)
            sieve[(hashes & low).astype(np.int64)] = True
            at = np.flatnonzero(sieve[(h & low).astype(np.int64)])
            at = at[hashes[np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)] == h[at]]
            at = at[at + size <= words.last[words.doc[at]]]
            for j in at.tolist():
                d = int(words.doc[j])
                starts.update((d, i, j - o) for i, o in pieces[size][int(h[j])])
        if not starts:
            return []
        todo = sorted(starts)
        rows, kept = [], []
        for d, i, s in todo:
            a, b = int(words.first[d]), int(words.last[d])
            s0 = max(a, s)
            rows.append(words.hash[s0 : min(b, s0 + len(seqs[i]))])
            kept.append((d, i, s0))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for c in range(0, len(rows), 4096):
            tokens, _ = padded(rows[c : c + 4096])
            lens = np.array([len(seqs[i]) for _, i, _ in kept[c : c + 4096]], np.int64)
            if tokens.shape[1] < lens.max():
                tokens = np.concatenate([tokens, np.zeros((len(tokens), lens.max() - tokens.shape[1]), np.uint64)], axis=1)
            meet = (tables.keys(tokens, lens) == item_keys[[i for _, i, _ in kept[c : c + 4096]]]).any(axis=1) if tables else np.ones(len(lens), bool)
            for (d, i, s), m in zip(kept[c : c + 4096], meet.tolist()):
                if not m:
                    continue
                a, b, k = int(words.first[d]), int(words.last[d]), edits[i]
                lo, hi = max(a, s - k), min(b, s + len(seqs[i]) + k)
                hit = edit_distance_within(seqs[i].tolist(), words.hash[lo:hi].tolist(), k)
                if hit:
                    x = (hit[0], max(0, lo + hit[1] - len(seqs[i]) - a))
                    best[d, i] = min(best.get((d, i), x), x)
        return [(d, ids[i], x[0], len(seqs[i]), x[1]) for (d, i), x in sorted(best.items())]

    def run(batches):
        for batch in batches:
            for part, block in B.in_blocks(batch, "t"):
                got = leaks(block)
                if got:
                    d, i, e, n, s = zip(*got)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), *[pa.array(x, pa.int64()) for x in (i, e, n, s)]], names=["doc_id", "item_id", "edits", "item_tokens", "first_token"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(run, SCHEMA)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99, block_items: int = 5000, block_bytes: int = 16 << 20, seed: int = 11) -> DataFrame:
    """Which rows of docs hold a passage close to a benchmark item.

    Returns a row per row of docs and item: doc_id, item_id, edits (the least token edit
    distance found), item_tokens, first_token (about where the passage begins).  The items are
    the query set, taken in blocks of about `block_items` and `block_bytes`, each sent to every task; docs are never
    shuffled.  Null or tokenless texts match nothing; repeated rows match alike; a null doc_id
    or item_id stays null; other columns are ignored.  Where no number of tables would reach
    the recall, all windows that align with a piece are verified, and none is lost.
    """
    B.prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sizes = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-sizes[0] // block_items), -(-(sizes[1] or 0) // block_bytes))
    out = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found = _leaks_of(docs, [(r[0], r[1]) for r in part], max_edits, recall, seed)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99) -> DataFrame:
    """The rows of docs (with all columns) whose doc_id has no leak; rows with a null doc_id stay."""
    B.prepare(docs.sparkSession)
    bad = benchmark_leaks(docs, benchmark, max_edits, recall).filter("doc_id is not null").select(F.col("doc_id").alias("_leaky")).distinct().checkpoint()
    few = bad.limit(100_001).count() <= 100_000
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"] == bad["_leaky"], "left_anti")
