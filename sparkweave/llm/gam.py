"""A quality classifier: a generalised additive model with pairwise interactions.

Whole texts become a dozen ratios, kept in a checkpointed table.  Cutting points are quantiles of
the training rows.  On a bounded sample of them, boosting goes round the features: at each turn one
shallow tree over one feature's bins moves that feature's table by a small step (Newton steps of
the logistic loss).  Then the pairs of features whose grids still explain most of the gradient get
tables in the same way.  A score is the sum of the tables at a row's bins, through a sigmoid, so
scoring is a vectorised lookup and each table can be read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks as B
from .quality import block_counts

#: Labelled rows that a fit sees at most (about; rows are chosen by hash).
MAX_ROWS = 20_000
BINS, GRID, PAIRS, ROUNDS, STEP, RIDGE = 48, 12, 8, 120, 0.12, 2.0
#: Text counted at once; smaller blocks than elsewhere are faster here and bound a worker's arrays.
BLOCK_BYTES = 1 << 18
#: A feature's expression over the counts of a text; none of them grows with its length alone but the first.
FEATURES = {
    "size": "log1p(n_words)",
    "word_chars": "word_chars / greatest(n_words, 1)",
    "longest": "log1p(longest)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "wide": "n_wide / greatest(word_chars, 1)",
    "bare": "n_bare / greatest(n_words, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
    "doubled": "n_doubled / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "log1p(n_words / greatest(n_lines, 1))",
}


def _set(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_LETTER, _DIGIT, _STOP = _set(bytes([*range(65, 91), *range(97, 123)])), _set(b"0123456789"), _set(b".,;:?")


def text_features(block: B.Block) -> dict[str, np.ndarray]:
    """block_counts() and further counts of each document."""
    out, data, words = block_counts(block), block.data, block.words()
    doc_sum = lambda flags: (lambda s: s[block.ends] - s[block.starts])(np.concatenate([[0], np.cumsum(flags)]))
    word_sum = lambda x: (lambda s: s[words.last] - s[words.first])(np.concatenate([[0], np.cumsum(x)]))
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    inked = np.concatenate([[0], np.cumsum(_LETTER[data] | _DIGIT[data] | (data >= 0xC0))])
    chars = points[words.ends] - points[words.starts]
    longest = np.zeros(len(block.ids), np.int64)
    np.maximum.at(longest, words.doc, chars)
    doubled = np.zeros(len(words.hash), bool)
    doubled[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    own = np.unique(np.stack([words.doc.astype(np.uint64), words.hash]), axis=1)[0] if len(words.hash) else np.zeros(0, np.uint64)
    return out | {
        "n_letters": doc_sum(_LETTER[data] | (lead & (data >= 0xC0))),
        "n_digits": doc_sum(_DIGIT[data]),
        "n_wide": doc_sum(lead & (data >= 0xC0)),
        "longest": longest,
        "n_bare": word_sum(inked[words.ends] == inked[words.starts]),
        "n_ends": word_sum(_STOP[data[words.ends - 1]] if len(words.ends) else np.zeros(0, bool)),
        "n_doubled": word_sum(doubled),
        "n_distinct": np.bincount(own.astype(np.int64), minlength=len(block.ids)),
    }


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, and the FEATURES) of each whole text; a null one is empty."""
    names = list(text_features(B.Block.of([0], [b""])))

    def run(batches):
        for batch in batches:
            for part, block in B.in_blocks(batch, "t", BLOCK_BYTES):
                counts = text_features(block)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(counts[c].astype(np.int64)) for c in names]], names=["doc_id", *names])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    out = cols.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), *[F.expr(f"cast({x} as double)").alias(f"f_{c}") for c, x in FEATURES.items()])


@dataclass
class Model:
    """Cutting points of each feature, of each feature for pairs, and the tables of both."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        fine, total = self.bins(x, self.cuts), np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[fine[:, k]]
        if self.pairs:
            rough = self.bins(x, self.coarse)
            for (a, b), grid in zip(self.pairs, self.grids):
                total += grid[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of these bins in two."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _leaf(g, h) -> float:
    return -STEP * g.sum() / (h.sum() + RIDGE)


def tree_over_bins(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of each bin, by a tree of two levels."""
    out = np.zeros(len(g))
    _, k = _best_cut(g, h)
    for a, b in ((0, k), (k, len(g))):
        gain, m = _best_cut(g[a:b], h[a:b])
        for i, j in ((a, a + m), (a + m, b)) if gain > 0 else ((a, b),):
            out[i:j] = _leaf(g[i:j], h[i:j])
    return out


def tree_over_grid(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of each cell, by a tree that cuts one feature and then, on each side, the other."""
    best = None
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        step, total = np.zeros(gt.shape), 0.0
        gain, k = _best_cut(gt.sum(axis=1), ht.sum(axis=1))
        for a, b in ((0, k), (k, len(gt))):
            more, m = _best_cut(gt[a:b].sum(axis=0), ht[a:b].sum(axis=0))
            total += more
            for i, j in ((0, m), (m, gt.shape[1])) if more > 0 else ((0, gt.shape[1]),):
                step[a:b, i:j] = _leaf(gt[a:b, i:j], ht[a:b, i:j])
        if best is None or total + gain > best[0]:
            best = total + gain, step.T if turned else step
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], pairs: int = PAIRS, rounds: int = ROUNDS) -> Model:
    """Cyclic boosting of the features' tables, then of the best pairs' grids; y holds 0 and 1."""
    coarse = [c[np.unique(np.linspace(0, len(c) - 1, GRID - 1).astype(int))] if len(c) else c for c in cuts]
    good = (y.sum() + 0.5) / (len(y) + 1)
    m = Model(cuts, coarse, float(np.log(good / (1 - good))), [np.zeros(len(c) + 1) for c in cuts])
    total = np.full(len(y), m.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    fine, rough = m.bins(x, cuts), m.bins(x, coarse)
    for _ in range(rounds):
        for k, t in enumerate(m.tables):
            if len(t) > 1:
                g, h = (np.bincount(fine[:, k], s, len(t)) for s in slopes())
                step = tree_over_bins(g, h)
                t += step
                total += step[fine[:, k]]
    cells = lambda a, b, s: np.bincount(rough[:, a] * (len(coarse[b]) + 1) + rough[:, b], s, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)
    g, h = slopes()
    left = {(a, b): float((cells(a, b, g) ** 2 / (cells(a, b, h) + RIDGE)).sum()) for a, b in combinations(range(len(cuts)), 2) if len(coarse[a]) and len(coarse[b])}
    m.pairs = sorted(left, key=lambda k: (-left[k], k))[:pairs]
    m.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in m.pairs]
    for _ in range(rounds // 2):
        for (a, b), grid in zip(m.pairs, m.grids):
            step = tree_over_grid(*(cells(a, b, s) for s in slopes()))
            grid += step
            total += step[rough[:, a], rough[:, b]]
    return m


def _fitted(rows: DataFrame, names: list[str], max_rows: int, seed: int) -> Model | None:
    """The model of rows(names, quality): quantiles of all of them, boosting on max_rows by hash, in one task."""
    n = rows.count()
    if not n:
        return None
    shares = [k / BINS for k in range(BINS)]
    first = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).first()
    cuts = [np.unique(np.array(first[c])) for c in names]
    share = min(1.0, max_rows / n)
    some = rows.filter(F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1 << 30)) < int(share * (1 << 30)))

    def boost(table: pa.Table) -> pa.Table:
        x, y = np.stack([table.column(c).to_numpy() for c in names], axis=1), table.column("quality").to_numpy().astype(float)
        order = np.lexsort((y, *x.T))  # the sums do not depend on how rows arrive
        m = fit(x[order], y[order], cuts)
        parts = [("base", 0, 0, np.array([m.base])), *[("table", k, k, t) for k, t in enumerate(m.tables)], *[("grid", a, b, t.reshape(-1)) for (a, b), t in zip(m.pairs, m.grids)]]
        return pa.table({"kind": [p[0] for p in parts], "a": pa.array([p[1] for p in parts], pa.int32()), "b": pa.array([p[2] for p in parts], pa.int32()), "v": pa.array([p[3].tolist() for p in parts], pa.list_(pa.float64()))})

    fitted = some.groupBy(F.lit(0).alias("one")).applyInArrow(boost, "kind string, a int, b int, v array<double>").collect()
    m = Model(cuts, [c[np.unique(np.linspace(0, len(c) - 1, GRID - 1).astype(int))] if len(c) else c for c in cuts])
    m.tables = [np.zeros(len(c) + 1) for c in cuts]
    for r in fitted:
        if r["kind"] == "base":
            m.base = r["v"][0]
        elif r["kind"] == "table":
            m.tables[r["a"]] = np.array(r["v"])
        else:
            m.pairs.append((r["a"], r["b"]))
            m.grids.append(np.array(r["v"]).reshape(len(m.coarse[r["a"]]) + 1, -1))
    return m


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS, seed: int = 29) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels: doc_id, quality.

    score: the chance that the label is 1, from the text alone.  Rows whose crc32(doc_id as text) mod 4
    is 2 are held out of the fit.  Labels other than 0 and 1 and null doc_ids are ignored; of repeated
    labels the least counts.  A null text is an empty one, a null doc_id has no label and is not held out;
    repeated rows each get a row.  Without labelled training rows every score is 0.5.  max_rows bounds the
    labelled rows of the fit; texts, quantiles and scores cover all rows.
    """
    B.prepare(docs.sparkSession)
    table = features(docs).checkpoint()
    names = [f"f_{c}" for c in FEATURES]
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = table.filter("not held_out").join(known, "doc_id").select(*names, F.col("quality").cast("int").alias("quality")).checkpoint()
    model = _fitted(rows, names, max_rows, seed)

    def score(batches):
        for batch in batches:
            x = np.stack([batch.column(k + 2).to_numpy() for k in range(len(names))], axis=1) if batch.num_rows else np.zeros((0, len(names)))
            s = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["doc_id", "held_out", "score"])

    out = table.select("doc_id", "held_out", *names).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
