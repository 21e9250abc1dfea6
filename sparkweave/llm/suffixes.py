"""Suffix-array dedup: repeated byte strings by merging shard Burrows-Wheeler transforms.

Each start of a string of `length` bytes is owned by an anchor: the minimum of
k-mer hashes over the first half of the string, which depends on the string
alone.  Strings that are equal have anchors at equal distances, so only suffixes
whose anchors share the middle part can share a string; Spark counts the middle
parts and drops the rest (nearly all of a clean corpus).

What is left is merged by *interleave refinement*: the suffixes of all shards
(blocks) that share a middle part begin as one interval of the merged order;
every round refines intervals by the next symbol and records the common prefix
where an interval splits.  Then LF steps carry the merged order to the left, one
preceding byte (the transform's symbol) at a time: a stable partition, with the
common prefixes carried along as range minima.  No suffix is sorted anew; an
adjacent pair whose common prefix reaches the length is a repeated interval.

An interval with more suffixes than one task should hold is refined by Spark
instead, with the same result: its range of distances to the anchor is halved
(so the shared part grows) until parts are small, wholly equal, or unique.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B

KMER = 24
SMALL = 64  # suffixes of an interval that one task merges; larger ones are halved

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ROWS = "key long, u long, block long, a long, lo int, hi int, node_lo int, node_hi int"


def anchors(block: B.Block, roll: B.Rolling, length: int, width: int):
    """(a, s, e): each anchor's place, and the first and last start of a string that it owns."""
    n = len(block.data)
    k = min(KMER, length - width + 1)
    long = block.lens >= length
    if not long.any():
        return (np.zeros(0, np.int64),) * 3
    least = (roll.every(k) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - k + 1, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    mark = np.zeros(n + 1, np.int8)
    mark[block.starts[long]] += 1
    mark[block.ends[long] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], start[first], start[last]


def merge(shared, left, left_len, right, right_len, reach):
    """Which suffixes share, at each distance d from 0 to reach, d bytes to the left and reach - d to the right.

    shared: the interval of each suffix (equal middle parts); left, right: bytes beside the
    middle part, outwards.  Returns a matrix of booleans, suffix by distance.
    """
    n, width = len(shared), right.shape[1]
    found = np.zeros((n, reach + 1), bool)
    symbols = right.view(">u8").astype(np.uint64) if width else np.zeros((n, 0), np.uint64)
    order = np.argsort(shared, kind="stable")
    split = np.ones(n + 1, bool)  # where an interval of the merged order begins
    split[1:n] = shared[order][1:] != shared[order][:-1]
    common = np.where(split, -1, width)  # with the suffix before, to the right of the middle part
    for h in range(symbols.shape[1]):
        alone = split[:-1] & split[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        interval = np.cumsum(split[:-1])[at]
        order[at] = order[at][np.lexsort((symbols[order[at], h], interval))]
        s = symbols[order[at], h]
        cut = np.flatnonzero((interval[1:] == interval[:-1]) & (s[1:] != s[:-1])) + 1
        x = s[cut] ^ s[cut - 1]
        same = np.zeros(len(cut), np.int64)
        for byte in range(7, 0, -1):
            same += x < (np.uint64(1) << np.uint64(8 * byte))
        split[at[cut]] = True
        common[at[cut]] = 8 * h + same
    interval = np.cumsum(split[:-1])
    order = order[np.lexsort((right_len[order], interval))]
    common[1:n] = np.minimum(common[1:n], np.minimum(right_len[order[1:]], right_len[order[:-1]]))
    interval = np.cumsum(common[:-1] < 0)
    for d in range(reach + 1):
        if len(order) < 2:
            break
        pair = np.flatnonzero(common[1 : len(order)] >= reach - d) + 1
        found[order[pair], d] = found[order[pair - 1], d] = True
        if d == reach:
            break
        at = np.flatnonzero(left_len[order] > d)  # an LF step
        if len(at) < 2:
            break
        key = interval[at] * 256 + left[order[at], d]
        moved = np.argsort(key, kind="stable")
        at, key = at[moved], key[moved]
        fresh = np.ones(len(at) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        if len(at) > 1:
            ends = np.empty(2 * (len(at) - 1), np.int64)
            ends[0::2], ends[1::2] = at[:-1] + 1, at[1:] + 1
            low = np.minimum.reduceat(np.append(common, -1), ends)[0::2]
        now = np.full(len(at) + 1, -1)
        now[1:-1] = np.where(fresh[1:-1], -1, low)
        stay = ~(fresh[:-1] & fresh[1:])
        order, interval = order[at][stay], np.cumsum(fresh[:-1])[stay]
        common = np.append(now[:-1][stay], -1)
    return found


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _keys(roll, a, lo, hi, node_lo, node_hi, length):
    """Hashes of what all strings of a node share, and of all that this suffix's strings cover."""
    tag = B.mix((node_lo.astype(np.uint64) << np.uint64(20)) + node_hi.astype(np.uint64) + np.uint64(1))
    key = B.mix(roll.at(a - node_lo, a + length - node_hi) ^ tag)
    own = B.mix((lo.astype(np.uint64) << np.uint64(20)) + hi.astype(np.uint64) + np.uint64(7))
    return key, B.mix(roll.at(a - hi, a + length - lo) ^ own ^ tag)


def repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else.

    Returns one row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the bytes left).  Strings do not cross documents, overlaps count,
    and all is judged on the input.  A null text is empty; a null doc_id stays null; rows
    that share a doc_id are different places.  Other columns are ignored.  Hashes have 64 bits.
    """
    width = length // 2
    blocks = B.pack(docs)
    buckets = B.buckets_for(blocks, share=0.1)

    def places(block):
        roll = B.Rolling(B.BYTE[block.data])
        a, s, e = anchors(block, roll, length, width)
        zero, top = np.zeros(len(a), np.int64), np.full(len(a), width - 1)
        key, u = _keys(roll, a, a - e, a - s, zero, top, length) if len(a) else (np.zeros(0, np.uint64),) * 2
        return a, s, e, key, u

    def send(number, block):
        key = np.sort(places(block)[3])
        known, n = np.unique(key, return_counts=True)
        return B.sent(number, known, (n > 1).astype(np.uint8), buckets)

    def repeated(h, many, part):
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        out = many.copy()
        out[order[1:][same]] = 1
        out[order[:-1][same]] = 1
        return out

    answers = B.exchange(B.each_block(blocks, send, B.SENT_SCHEMA), repeated, np.uint8)

    def suspects(number, block, got):
        a, s, e, key, u = places(block)
        known = np.unique(key)
        hit = B.answers_for(known, got, buckets, np.uint8)[np.searchsorted(known, key)] > 0 if len(key) else np.zeros(0, bool)
        a, s, e, key, u = (x[hit] for x in (a, s, e, key, u))
        n = len(a)
        return pa.table({
            "key": _signed(key), "u": _signed(u), "block": np.full(n, number, np.int64), "a": a,
            "lo": (a - e).astype(np.int32), "hi": (a - s).astype(np.int32),
            "node_lo": np.zeros(n, np.int32), "node_hi": np.full(n, width - 1, np.int32),
        })

    rows = B.per_block(blocks, answers, suspects, ROWS).withColumn("weight", F.lit(1)).checkpoint()
    whole, open_rows = _settle(rows)
    found = [whole]

    def contexts(number, block, wanted):
        a, lo, hi = (wanted.column(c).to_numpy().astype(np.int64) for c in ("a", "lo", "hi"))
        ctx = [block.body[i:j] for i, j in zip((a - hi).tolist(), (a - lo + length).tolist())]
        return wanted.append_column("ctx", pa.array(ctx, pa.binary()))

    level = B.with_rows(blocks, open_rows, contexts, OPEN + ", ctx binary").checkpoint()
    while True:
        sized = level.join(level.groupBy("key").agg(F.count("*").alias("members")), "key")
        found.append(_merged(sized.filter(F.col("members") <= SMALL).drop("members"), length))
        big = sized.filter(F.col("members") > SMALL).drop("members")
        if big.isEmpty():
            break
        halves = _halved(big, length).checkpoint()
        whole, level = _settle(halves)
        found.append(whole)
        level = level.checkpoint()
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)

    def remove(number, block, wanted):
        n = len(block.data)
        diff = np.zeros(n + 1, np.int32)
        np.add.at(diff, wanted.column("first").to_numpy(), 1)
        np.add.at(diff, wanted.column("last").to_numpy() + length, -1)
        gone = np.cumsum(diff[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        spans = np.concatenate([[0], np.cumsum(opens)])
        removed = sums[block.ends] - sums[block.starts]
        sha = []
        for i, m in enumerate(removed.tolist()):
            kept = block.text(i)
            if m:
                at = slice(block.starts[i], block.ends[i])
                kept = block.data[at][~gone[at]].tobytes()
            sha.append(hashlib.sha256(kept).hexdigest())
        return pa.table({
            "doc_id": B.ids_out(block.ids), "n_bytes": block.lens, "n_removed": removed,
            "n_spans": spans[block.ends] - spans[block.starts], "kept_sha256": sha,
        })

    return B.with_rows(blocks, spans, remove, RESULT)


OPEN = ROWS + ", weight int"
SPANS = "block long, first long, last long"


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are decided as a whole, as spans of repeated starts; and those still open.

    A key that occurs once is unique and drops out.  Where all that a suffix's strings cover
    occurs twice (u), all its strings are repeated; one such suffix stays as the partner of
    open ones, with weight 2.  A key with one u only has nothing open.  All are sums by key.
    """
    by_u = rows.groupBy("u").agg(F.sum("weight").alias("same"), F.min(F.struct("block", "a")).alias("one"), F.first("key").alias("key"))
    by_key = by_u.groupBy("key").agg(F.sum("same").alias("total"), F.count("*").alias("kinds"))
    told = rows.join(by_u.drop("key"), "u")
    whole = told.filter("same > 1 and weight = 1").select("block", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))
    left = told.filter(F.struct("block", "a") == F.col("one")).join(by_key.filter("kinds > 1").select("key"), "key", "left_semi")
    left = left.withColumn("weight", F.when(F.col("same") > 1, 2).otherwise(1))
    return whole, left.select([c for c in rows.columns])


def _beside(table: pa.Table, length: int):
    a_in = table.column("hi").to_numpy().astype(np.int64)  # a context begins at the anchor less hi
    node_lo, node_hi = (table.column(c).to_numpy().astype(np.int64) for c in ("node_lo", "node_hi"))
    lo = np.maximum(table.column("lo").to_numpy(), node_lo)
    hi = np.minimum(table.column("hi").to_numpy(), node_hi)
    return a_in, node_lo, node_hi, lo, hi


def _merged(rows: DataFrame, length: int, buckets: int = 512) -> DataFrame:
    """The repeated starts of intervals of at most SMALL suffixes each, many intervals in one task."""

    def one(table: pa.Table) -> pa.Table:
        out = {c: [] for c in ("block", "first", "last")}
        node = table.column("node_lo").to_numpy().astype(np.int64) * (1 << 20) + table.column("node_hi").to_numpy()
        for x in np.unique(node):
            part = table.filter(pa.array(node == x))
            a_in, node_lo, node_hi, lo, hi = _beside(part, length)
            lo0, reach, n = int(node_lo[0]), int(node_hi[0] - node_lo[0]), part.num_rows
            left, right = np.zeros((n, reach + 1), np.uint8), np.zeros((n, -(-(reach + 1) // 8) * 8), np.uint8)
            left_len, right_len = hi - lo0, node_hi - lo
            for i, ctx in enumerate(part.column("ctx").to_pylist()):
                data, a = np.frombuffer(ctx, np.uint8), a_in[i]
                left[i, : left_len[i]] = data[a - hi[i] : a - lo0][::-1]
                right[i, : right_len[i]] = data[a + length - node_hi[i] : a + length - lo[i]]
            _, shared = np.unique(part.column("key").to_numpy(), return_inverse=True)
            found = merge(shared, left, left_len, right, right_len, reach)
            found[part.column("weight").to_numpy() > 1] = False  # those are known
            at = part.column("a").to_numpy() - lo0
            edge = np.zeros((n, reach + 3), np.int8)
            edge[:, 1:-1] = found
            turn = np.diff(edge, axis=1)
            r, begin = np.nonzero(turn == 1)
            _, end = np.nonzero(turn == -1)
            out["block"].append(part.column("block").to_numpy()[r])
            out["first"].append(at[r] - (end - 1))
            out["last"].append(at[r] - begin)
        return pa.table({c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return rows.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: one(t), SPANS)


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Each suffix once for each half of its node that it has strings in, with the keys of the halves."""

    def halve(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            a_in, node_lo, node_hi, lo, hi = _beside(table, length)
            rolls = [B.Rolling(B.BYTE[np.frombuffer(x, np.uint8)]) for x in table.column("ctx").to_pylist()]
            mid = (node_lo + node_hi) // 2
            for a0, b0 in ((node_lo, mid), (mid + 1, node_hi)):
                l, h = np.maximum(lo, a0), np.minimum(hi, b0)
                has = np.flatnonzero((l <= h) & (a0 <= b0))
                pairs = [_keys(rolls[i], a_in[i : i + 1], l[i : i + 1], h[i : i + 1], a0[i : i + 1], b0[i : i + 1], length) for i in has]
                part = table.take(pa.array(has))
                # Contexts are cut to what the half needs.
                ctx = [c[a_in[i] - h[i] : a_in[i] - l[i] + length] for i, c in zip(has, part.column("ctx").to_pylist())]
                new = {
                    "key": _signed(np.array([k[0] for k, _ in pairs], np.uint64)), "u": _signed(np.array([u[0] for _, u in pairs], np.uint64)),
                    "block": part.column("block"), "a": part.column("a"), "lo": l[has].astype(np.int32), "hi": h[has].astype(np.int32),
                    "node_lo": a0[has].astype(np.int32), "node_hi": b0[has].astype(np.int32), "weight": part.column("weight"), "ctx": pa.array(ctx, pa.binary()),
                }
                yield from pa.table(new).to_batches()

    return rows.select(*[c.split()[0] for c in OPEN.split(", ")], "ctx").mapInArrow(halve, OPEN + ", ctx binary")
