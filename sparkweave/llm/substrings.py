"""Substring dedup over words by difference-cover anchors.

A *difference cover* modulo v is a set D such that every difference modulo v is
a difference of two members.  For two equal passages at word positions i and j
there is then a shift below v after which both positions are in D, so a match
of v + m - 1 words always contains an anchor (m words) that starts at a cover
position in both documents.  Anchors are hashed at cover positions only; shared
ones are extended to whole windows, and the windows decide.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B

#: Perfect difference sets modulo q*q+q+1 (fixed values): every non-zero difference occurs once.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves an anchor of 40 % of the window at least; 1 for short windows."""
    fit = [v for v in COVERS if window - v + 1 >= max(2, 0.4 * window)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def anchor_positions(words: B.Words, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    length = window - period + 1
    n = words.last - words.first
    at = np.arange(len(words.hash)) - np.repeat(words.first, n)
    mask = np.zeros(period, bool)
    mask[list(cover)] = True
    return np.flatnonzero(mask[at % period] & (at + length <= np.repeat(n, n)) & (np.repeat(n, n) >= window))


def candidate_windows(words: B.Words, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of the windows (within one document) that contain one of these anchors."""
    diff = np.zeros(len(words.hash) + 1, np.int64)
    first = words.first[words.doc[anchors]]
    np.add.at(diff, np.maximum(anchors - (period - 1), first), 1)
    np.add.at(diff, anchors + 1, -1)
    start = np.flatnonzero(np.cumsum(diff[:-1]) > 0)
    return start[start + window <= words.last[words.doc[start]]]


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove words covered by a window of words that also starts in a document with a smaller doc_id.

    Returns one row per row of docs: doc_id, n_words, n_removed, kept_sha256 (kept
    words joined by one space), n_spans (maximal removed runs).  Judged on the input.
    A null text has no words; a null doc_id sorts before all others; rows that
    share a doc_id are one document for the comparison and do not remove each
    other's words.  Other columns of docs are ignored.  Window hashes have 64 bits.
    """
    period, cover = cover_for(window)
    length = window - period + 1
    blocks = B.pack(docs)
    buckets = B.buckets_for(blocks, share=0.4)

    def anchors_of(words):
        at = anchor_positions(words, window, period, cover)
        return at, B.Rolling(words.hash).every(length)[at] if len(at) else np.zeros(0, np.uint64)

    def send_anchors(number, block):
        words = block.words()
        at, h = anchors_of(words)
        h, _, many = B.distinct_by_doc(h, block.ids[words.doc[at]])
        return B.sent(number, h, many.astype(np.uint8), buckets)

    def shared(h, many, part):
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        out = np.zeros(len(s), np.uint8)
        out[order] = same
        return out | many

    answers = B.exchange(B.each_block(blocks, send_anchors, B.SENT_SCHEMA), shared, np.uint8)

    answers = answers.checkpoint()  # needed twice, and small

    def windows_of(block, words, got):
        at, h = anchors_of(words)
        known = np.unique(h)
        hit = B.answers_for(known, got, buckets, np.uint8)[np.searchsorted(known, h)] > 0 if len(h) else np.zeros(0, bool)
        start = candidate_windows(words, at[hit], window, period)
        return start, B.Rolling(words.hash).at(start, start + window)

    def send_windows(number, block, got):
        words = block.words()
        start, h = windows_of(block, words, got)
        h, least, _ = B.distinct_by_doc(h, block.ids[words.doc[start]])
        return B.sent(number, h, least, buckets)

    def smaller_elsewhere(h, least, part):
        order = np.lexsort((least, h))
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        out = np.zeros(len(s), np.uint8)
        out[order] = least[order][first] < least[order]
        return out

    verdicts = B.exchange(B.per_block(blocks, answers, send_windows, B.SENT_SCHEMA), smaller_elsewhere, np.int64)
    both = answers.unionByName(verdicts.withColumn("bucket", F.col("bucket") + buckets))

    def remove(number, block, got):
        words = block.words()
        start, h = windows_of(block, words, got)
        known, least, _ = B.distinct_by_doc(h, block.ids[words.doc[start]])
        bad = B.answers_for(known, {k - buckets: r for k, r in got.items() if k >= buckets}, buckets, np.uint8)
        at = np.searchsorted(known, h)
        hit = (bad[at] > 0) | (block.ids[words.doc[start]] > least[at])
        diff = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(diff, start[hit], 1)
        np.add.at(diff, start[hit] + window, -1)
        gone = np.cumsum(diff[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | (words.doc[1:] != words.doc[:-1])
        spans = np.concatenate([[0], np.cumsum(opens)])
        keep = (~gone).tolist()
        sha = []
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist())):
            kept = block.text(i).split()
            if sums[b] > sums[a]:
                kept = compress(kept, keep[a:b])
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({
            "doc_id": B.ids_out(block.ids),
            "n_words": words.last - words.first,
            "n_removed": sums[words.last] - sums[words.first],
            "kept_sha256": sha,
            "n_spans": spans[words.last] - spans[words.first],
        })

    return B.per_block(blocks, both, remove, RESULT)
