"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a bag of five-word shingles, weighted by how often each occurs.  Its
signature has m components; element d with weight w arrives as a Poisson process of
rate w, each arrival at a random component, and the first arrival at a component takes
it.  An element stops once its next arrival is later than every component's first, so
most elements cost one arrival.  Two signatures agree in a component with the
probability Jaccard similarity of the bags.

Bands of the signature give candidates.  In a small bucket all pairs are candidates.
In a larger one each member is compared with the bucket's hub (the member whose bands
are shared most widely).  Members near the hub are in its class; one that is not near it
is compared with all others of the hub's buckets, near the hub or not: in slices of
members, by sketches first, so that no bucket is expanded into rows of pairs, and none is
cut.  Candidates are verified on the exact bags; classes are the components of verified
links, found between distinct texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..graph import connected_components
from . import _blocks as B
from .quality import binomial_cdf

BANDS, ROWS = 26, 5
SMALL = 16
#: Members of large buckets are compared slice by slice, of so many documents and bytes of bags at most; sketches have so many components.
SLICE_DOCS, SLICE_BYTES, SKETCH = 4096, 4 << 20, 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(block: B.Block, words: int = 5):
    """(document, shingle, weight) of a block: distinct shingles by document; a shorter text is one shingle."""
    w = block.words()
    n = w.last - w.first
    size = np.minimum(n, words)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = np.repeat(w.first, count) + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    h = B.Rolling(w.hash).at(start, start + size[doc])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def prob_min_hash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures (docs by m, the item that arrives first at each component); 0 for empty bags."""
    first = np.full(docs * m, np.inf)
    sig = np.zeros(docs * m, np.uint64)
    last = np.full(docs, np.inf)  # when the latest component of a document was taken
    at, rate, step = np.zeros(len(item)), weight.astype(float), 0
    while len(item):
        u = B.mix(item + np.uint64(int(_GOLD) * (2 * step + 1) % 2**64))
        at = at - np.log1p(-(u >> np.uint64(11)).astype(float) * 2.0**-53) / rate
        on = at < last[doc]
        doc, item, at, rate, u = doc[on], item[on], at[on], rate[on], u[on]
        slot = doc * m + (B.mix(u ^ _GOLD) % np.uint64(m)).astype(np.int64)
        new = np.flatnonzero(at < first[slot])
        new = new[np.argsort(-at[new], kind="stable")]  # of several at one slot the earliest is written last
        first[slot[new]], sig[slot[new]] = at[new], item[new]
        step += 1
        if step < 6 or step % 12 == 0:
            some = np.unique(doc)
            last[some] = first.reshape(docs, m)[some].max(axis=1)
    return sig.reshape(docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(B.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        h = B.mix(h * _GOLD + parts[:, :, r])
    return h


def probability_jaccard(a, wa, b, wb) -> float:
    """Exact J_P of two weighted bags (sorted items): the sum over common items d of
    1 / sum over d' of max(a(d')/a(d), b(d')/b(d)), by prefix sums over items sorted by b/a."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (wa == 1).all() and (wb == 1).all():
        return len(common) / (len(a) + len(b) - len(common))
    x, y = wa[i].astype(float), wb[j].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    low = np.cumsum(x)  # items whose b/a is not above: a(d')/a(d) is the larger
    high = y.sum() - np.cumsum(y)
    return float((1.0 / ((only_a + low) / x + (only_b + high) / y)).sum())


def agreement_needed(similarity: float, m: int, miss: float = 1e-6) -> int:
    """As many of m components agree in all but a share `miss` of the pairs at this similarity."""
    k = 0
    while k < m and binomial_cdf(k, m, min(similarity, 0.999)) <= miss:
        k += 1
    return k


_SLICE = "hub long, near boolean, salt int, nodes binary, lens binary, items binary, weights binary, sketch binary"


def _sliced(table: pa.Table) -> pa.Table:
    """Members (hub, near, salt, node, items, weights) of one slice as one row, with a sketch of each."""
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    weights = [np.frombuffer(w, np.uint32) if w else np.ones(len(x), np.uint32) for x, w in zip(items, table.column("weights").to_pylist())]
    lens = np.array([len(x) for x in items], np.int64)
    items, weights = np.concatenate(items), np.concatenate(weights)
    sketch = prob_min_hash(np.repeat(np.arange(len(lens)), lens), items, weights, len(lens), SKETCH)
    sketch = (B.mix(sketch) >> np.uint64(56)).astype(np.uint8)
    press = zstandard.ZstdCompressor(level=3)
    columns = {"nodes": table.column("node").to_numpy(), "lens": lens, "items": items, "weights": weights, "sketch": sketch}
    return pa.table({k: table.column(k).slice(0, 1) for k in ("hub", "near", "salt")} | {k: pa.array([press.compress(v.tobytes())], pa.binary()) for k, v in columns.items()})


class Slice:
    """Nodes with their bags and sketches."""

    def __init__(self, nodes: bytes, lens: bytes, items: bytes, weights: bytes, sketch: bytes):
        opened = zstandard.ZstdDecompressor()
        read = lambda x, kind: np.frombuffer(opened.decompress(x), kind)
        self.nodes, self.items, self.weights = read(nodes, np.int64), read(items, np.uint64), read(weights, np.uint32).astype(np.int64)
        self.cut = np.concatenate([[0], np.cumsum(read(lens, np.int64))])
        self.sketch = read(sketch, np.uint8).reshape(len(self.nodes), -1)

    def bag(self, i: int):
        part = slice(self.cut[i], self.cut[i + 1])
        return self.items[part], self.weights[part]


def crossed(x: Slice, y: Slice, near: bool, similarity: float) -> list[tuple[int, int]]:
    """Links between two slices (or within one, if x is y), enough to join all that their links join.

    near: the nodes of y are in one class already.  All pairs of different classes whose sketches
    allow the similarity are verified on the exact bags.
    """
    need, out = agreement_needed(similarity, x.sketch.shape[1]), []
    class_x = np.arange(len(x.nodes))
    class_y = class_x if x is y else np.full(len(y.nodes), len(x.nodes)) if near else len(x.nodes) + np.arange(len(y.nodes))
    for i in range(len(x.nodes)):
        agree = np.count_nonzero(y.sketch == x.sketch[i], axis=1)
        some = np.flatnonzero((agree >= need) & (class_y != class_x[i]))
        if x is y:
            some = some[some > i]
        some = some[np.argsort(-agree[some], kind="stable")]
        while len(some):
            (a, u), (b, v) = x.bag(i), y.bag(some[0])
            if probability_jaccard(a, u, b, v) >= similarity:
                out.append((int(x.nodes[i]), int(y.nodes[some[0]])))
                old, new = class_y[some[0]], class_x[i]
                class_x[class_x == old] = new
                class_y[class_y == old] = new
                some = some[class_y[some] != new]
            else:
                some = some[1:]
    return out


def _left_over(large: DataFrame, near: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Links that the hubs did not show; large(bucket, node, hub), near: the verified links to hubs.

    Members of all buckets of a hub are one group.  Two members near the hub are in one class;
    every other pair of the group is compared, slice by slice, each pair of slices a row.
    """
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "node", "b": "hub"})
    group = large.filter("node <> hub").select("hub", "node").distinct()
    group = group.join(both.withColumn("near", F.lit(True)), ["hub", "node"], "left").select("hub", "node", F.coalesce("near", F.lit(False)).alias("near")).checkpoint()
    group = group.join(group.filter("not near").select("hub").distinct(), "hub", "left_semi")
    held = group.join(profiles.select("node", "p.items", "p.weights"), "node")
    sizes = held.groupBy("hub", "near").agg(F.count("*").alias("n"), F.sum(F.length("items") + F.length("weights")).alias("bytes"))
    sizes = sizes.select("hub", "near", F.greatest(F.ceil(F.col("n") / SLICE_DOCS), F.ceil(F.col("bytes") / SLICE_BYTES)).alias("slices"))
    held = held.join(sizes, ["hub", "near"]).withColumn("salt", F.pmod(F.xxhash64("node"), "slices").cast("int")).drop("slices")
    slices = held.groupBy("hub", "near", "salt").applyInArrow(_sliced, _SLICE).checkpoint()

    keys = slices.select("hub", "near", "salt")
    tiles = keys.filter("not near").select("hub", F.col("salt").alias("xs")).join(keys.withColumnsRenamed({"near": "yn", "salt": "ys"}), "hub").filter("yn or ys >= xs")
    data = F.struct("nodes", "lens", "items", "weights", "sketch")
    tiles = tiles.join(slices.filter("not near").select("hub", F.col("salt").alias("xs"), data.alias("x")), ["hub", "xs"])
    tiles = tiles.join(slices.select("hub", F.col("near").alias("yn"), F.col("salt").alias("ys"), data.alias("y")), ["hub", "yn", "ys"])
    tiles = tiles.repartition("hub", "xs", "yn", "ys").select("x", "y", "yn", (~F.col("yn") & (F.col("xs") == F.col("ys"))).alias("same"))

    def cross(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, yn, same = (c[k].as_py() for c in batch.columns)
                x = Slice(**x)
                pairs = crossed(x, x if same else Slice(**y), yn, similarity)
                yield pa.RecordBatch.from_pydict({c: pa.array([p[i] for p in pairs], pa.int64()) for i, c in enumerate("ab")})

    return tiles.mapInArrow(cross, "a long, b long")


def _candidates(members: DataFrame, links, profiles: DataFrame, similarity: float) -> DataFrame:
    """Verified links of all buckets; members(bucket, node), links(pairs) -> pairs that hold."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    held = members.join(sizes, "bucket").checkpoint()
    few = held.filter(F.col("size") <= SMALL).select("bucket", "node")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.bucket = y.bucket and x.node < y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = held.filter(F.col("size") > SMALL).select("bucket", "node")
    more = not large.isEmpty()
    if more:
        popular = held.groupBy("node").agg(F.sum("size").alias("fame"))
        hubs = large.join(popular, "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("fame"), F.col("node"))).alias("hub"))
        large = large.join(hubs, "bucket").checkpoint()
        pairs = pairs.unionByName(large.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
    near = links(pairs.distinct()).checkpoint()
    return near.unionByName(_left_over(large, near, profiles, similarity)) if more else near


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The class of near-duplicates of each row of docs: doc_id, class_id (the smallest doc_id of its class).

    Documents are linked if the probability Jaccard similarity of their bags of `words`-word
    shingles is at least `similarity`, or if their texts are equal; classes are components.
    A text shorter than `words` words is one shingle; texts without words are linked only to
    equal texts.  Null text is empty.  Rows that share a doc_id are in one class; a row with a
    null doc_id is compared with nothing and has a null class_id.  Other columns are ignored.
    At the default bands a pair at the threshold is missed with probability 3e-5, and with 1e-6
    more where only a large bucket holds it.
    """
    spark = docs.sparkSession
    B.prepare(spark)
    blocks = B.pack(docs.filter("doc_id is not null"))
    m = BANDS * ROWS

    def sign(number, block):
        doc, item, weight = bags(block, words)
        h = band_hashes(prob_min_hash(doc, item, weight, len(block.ids), m), BANDS, ROWS).view(np.int64)
        some = np.zeros(len(block.ids), bool)
        some[doc] = True
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(block.ids), "block": np.full(len(some), number, np.int64), "row": np.arange(len(some), dtype=np.int32),
            "text_hash": pa.array([hashlib.md5(block.text(i)).digest() for i in range(len(some))], pa.binary()),
            "bands": pa.array([x if s else [] for x, s in zip(h.tolist(), some)], pa.list_(pa.int64())),
        })

    signed = B.each_block(blocks, sign, "doc_id long, block long, row int, text_hash binary, bands array<long>").checkpoint()
    texts = signed.groupBy("text_hash").agg(F.min_by(F.struct("doc_id", "block", "row", "bands"), F.struct("doc_id", "block", "row")).alias("x"))
    # A node is a text, numbered by the place of its first document: task, block of the task (20 bits), row (21 bits).
    place = F.shiftleft(F.shiftright("x.block", 32), 41) + F.shiftleft(F.col("x.block").bitwiseAND(F.lit(0xFFFFFFFF)), 21) + F.col("x.row")
    texts = texts.select("text_hash", place.alias("node"), F.col("x.doc_id").alias("least"), "x.block", "x.row", "x.bands").checkpoint()
    same = signed.select("doc_id", "text_hash").join(texts.select("text_hash", "node", "least"), "text_hash").select("doc_id", "node", "least")

    def profile(number, block, wanted):
        doc, item, weight = bags(block, words)
        cut = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        rows = wanted.column("row").to_pylist()
        parts = [slice(cut[r], cut[r + 1]) for r in rows]
        return pa.table({
            "node": wanted.column("node"), "items": pa.array([item[p].tobytes() for p in parts], pa.binary()),
            "weights": pa.array([b"" if (weight[p] == 1).all() else weight[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
        })

    members = texts.select("node", F.explode("bands").alias("bucket")).select("bucket", "node")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = members.join(shared, "bucket").checkpoint()
    needed = texts.select("node", "block", "row").join(members.select("node").distinct(), "node", "left_semi")
    profiles = B.with_rows(blocks, needed, profile, "node long, items binary, weights binary").select("node", F.struct("items", "weights").alias("p")).checkpoint()

    def verify(batches):
        for batch in batches:
            keep = []
            ids = [batch.column(k) for k in (0, 1)]
            for ia, wa, ib, wb in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                a, b = np.frombuffer(ia, np.uint64), np.frombuffer(ib, np.uint64)
                u, v = (np.frombuffer(w, np.uint32).astype(np.int64) if w else np.ones(len(x), np.int64) for x, w in ((a, wa), (b, wb)))
                keep.append(probability_jaccard(a, u, b, v) >= similarity)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in ids], names=["a", "b"])

    def links(pairs: DataFrame) -> DataFrame:
        side = lambda x: profiles.select(F.col("node").alias(x), F.col("p.items").alias(f"i{x}"), F.col("p.weights").alias(f"w{x}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b")
        return full.select("a", "b", "ia", "wa", "ib", "wb").mapInArrow(verify, "a long, b long")

    near = _candidates(members, links, profiles, similarity).select(F.col("a").alias("src"), F.col("b").alias("tgt"))
    # Rows that share a doc_id but not a text tie their texts together.
    tied = same.filter("doc_id <> least").select("doc_id", "node").unionByName(texts.select(F.col("least").alias("doc_id"), "node")).distinct()
    first = tied.groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    tied = tied.join(first, "doc_id").filter("node > first").select(F.col("first").alias("src"), F.col("node").alias("tgt"))
    classes = connected_components(near.unionByName(tied)).join(texts.select("node", "least"), "node").checkpoint()
    smallest = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = classes.select("node", "component").join(smallest, "component").select("node", "class_id")
    out = same.join(classes, "node", "left").select("doc_id", F.coalesce("class_id", "least").alias("class_id"))
    nulls = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nulls)


def one_of_each_class(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the smallest doc_id stays.

    Rows with a null doc_id stay; rows that share a doc_id stay or go together.
    """
    gone = near_duplicates(docs, similarity, words).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct().checkpoint()
    few = gone.limit(100_001).count() <= 100_000
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")
