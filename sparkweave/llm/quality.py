"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule is a ratio that grows with badness.  One half of the labelled documents
sets each rule's scale (a high quantile among good ones); a document's score is
its worst ratio in units of the scale.  The other half, the holdout, tests cutoffs
from lenient to strict: a cutoff is certified while the exact (Clopper-Pearson)
upper bound on the share of good documents that it rejects stays below `limit`.
Testing in a fixed order needs no correction within a stratum; across strata the
error `delta` is divided by their number (Bonferroni).  A stratum in which nothing
can be certified rejects nothing.  Equal texts of a stratum are one trial, labelled by the
worst of their labels, and are in the same half.  The bound is on what the cutoffs reject
among good documents that pass the base rules; what those rules reject is fixed beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import _blocks as B

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
RULES = {
    "r_symbols": "n_symbols / greatest(word_chars, 1)",
    "r_marks": "n_marks / greatest(n_words, 1)",
    "r_upper": "n_upper / greatest(word_chars, 1)",
    "r_dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "r_repeats": "n_repeat_words / greatest(n_words, 1)",
    "r_long_words": "greatest(word_chars / greatest(n_words, 1) - 6, 0)",
}
#: Cutoffs in units of a rule's scale, from lenient to strict.
CUTOFFS = [round(8 * 0.93**k, 4) for k in range(30)]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def _again(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: does its document have the hash twice, and did it have it before."""
    h = B.mix(hashes ^ B.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, before


def block_counts(block: B.Block) -> dict[str, np.ndarray]:
    words = block.words()
    data = block.data
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc_sum = lambda flags: (lambda s: s[block.ends] - s[block.starts])(np.concatenate([[0], np.cumsum(flags)]))
    word_sum = lambda x: (lambda s: s[words.last] - s[words.first])(np.concatenate([[0], np.cumsum(x)]))
    n = len(words.hash)
    three = np.flatnonzero(np.arange(n) + 3 <= words.last[words.doc]) if n else np.zeros(0, np.int64)
    twice, _ = _again(B.Rolling(words.hash).at(three, three + 3), words.doc[three])
    cover = np.zeros(n + 3, bool)
    for k in range(3):
        cover[three[twice] + k] = True
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
    line_doc = np.searchsorted(block.ends, start)
    inked = np.searchsorted(words.starts, start) < np.searchsorted(words.starts, stop)
    at = np.flatnonzero(inked)
    _, before = _again(B.Rolling(B.BYTE[data]).at(start[at], stop[at]), line_doc[at])
    return {
        "n_words": words.last - words.first,
        "word_chars": word_sum(points[words.ends] - points[words.starts]),
        "n_symbols": doc_sum(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_doc[at][before], minlength=len(block.ids)),
        "n_repeat_words": word_sum(cover[:n]),
        "n_lines": np.bincount(line_doc[at], minlength=len(block.ids)),
        "n_marks": doc_sum(_MARK[data]),
        "n_upper": doc_sum((data >= 65) & (data <= 90)),
    }


def text_counts(docs: DataFrame, stratum: str, carry: bool = False) -> DataFrame:
    """doc_id, stratum (of a null: '(none)'), text_hash and the counts of each document's whole text (null: empty).

    carry: the columns of docs too, as a struct `row`.
    """
    names = list(block_counts(B.Block.of([0], [b""])))

    def run(batches):
        for batch in batches:
            for part, block in B.in_blocks(batch, "t"):
                counts = block_counts(block)
                held = part.select(list(held_types))
                yield pa.RecordBatch.from_arrays([*held.columns, *[pa.array(counts[c].astype(np.int64)) for c in names]], names=[*held_types, *names])

    held_types = {"doc_id": T.LongType(), "stratum": T.StringType(), "text_hash": T.StringType()} | ({"row": docs.schema} if carry else {})
    schema = T.StructType([T.StructField(c, t) for c, t in (held_types | {c: T.LongType() for c in names}).items()])
    slim = docs.select(*([F.struct("*").alias("row")] if carry else []), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("(none)")).alias("stratum"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("t"))
    out = slim.mapInArrow(run, schema)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.withColumn("base_failed", failed).withColumns({c: F.expr(f"cast({x} as double)") for c, x in RULES.items()})


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, summed from k down until terms vanish; 1 where k is not below the mean."""
    if n <= 0 or k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return total


def risk_cutoffs(scored: DataFrame, limit: float, delta: float) -> DataFrame:
    """(stratum, cutoff) from rows (stratum, score, quality): the certified cutoff that rejects most bad ones.

    Among equals the most lenient; strata without a certified cutoff have no row.
    """
    grid = F.array(*map(F.lit, CUTOFFS))
    rank = F.size(F.filter(grid, lambda c: c >= F.col("score")))  # cutoffs[rank:] reject it
    bins = scored.groupBy("stratum", rank.alias("rank")).agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad"))
    steps = bins.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS)))).alias("rank"))
    run = Window.partitionBy("stratum").orderBy("rank")
    whole = Window.partitionBy("stratum")
    table = steps.join(bins, ["stratum", "rank"], "left").na.fill(0, ["good", "bad"])
    table = table.select(
        "stratum", "rank", F.sum("good").over(run).alias("k"), F.sum("bad").over(run).alias("caught"), F.sum("good").over(whole).alias("n"),
    ).filter(F.col("rank") < len(CUTOFFS))

    @F.pandas_udf("double")
    def chance(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), limit) for a, b in zip(k, n)])

    table = table.crossJoin(F.broadcast(bins.agg(F.countDistinct("stratum").alias("strata"))))  # one row
    table = table.withColumn("ok", (chance("k", "n") <= delta / F.col("strata")).cast("int"))
    table = table.withColumn("so_far", F.min("ok").over(run)).filter("so_far = 1")
    best = F.max_by(F.struct("rank", "k", "n"), F.struct(F.col("caught"), -F.col("rank")))
    return table.groupBy("stratum").agg(best.alias("b")).select("stratum", F.element_at(grid, F.col("b.rank") + 1).alias("cutoff"), F.col("b.k").alias("holdout_rejected"), F.col("b.n").alias("holdout_good"))


def _kept() -> Column:
    return ~F.col("base_failed") & ~F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False))


def _calibrated(docs, labels, stratum, limit, delta, quantile, seed) -> tuple[DataFrame, Column, DataFrame]:
    """Counts of docs, the score in units of the rules' scales, and the certified cutoffs."""
    B.prepare(docs.sparkSession)
    stats = text_counts(docs, stratum).checkpoint()
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = stats.filter("not base_failed").join(known, "doc_id").groupBy("stratum", "text_hash").agg(F.min("quality").alias("quality"), *[F.first(c).alias(c) for c in RULES])
    held = held.withColumn("half", F.pmod(F.xxhash64(F.lit(seed), "text_hash"), F.lit(2))).select("stratum", "quality", "half", *RULES).checkpoint()
    fit = held.filter("half = 0 and quality = 1").agg(*[F.percentile_approx(c, quantile, 10_000).alias(c) for c in RULES]).first()
    scale = {c: max(fit[c] or 0.0, 1e-3) * 1.25 if fit[c] is not None else None for c in RULES}
    worst = F.greatest(F.lit(0.0), *[F.col(c) / F.lit(s) for c, s in scale.items() if s is not None]) if any(s is not None for s in scale.values()) else F.lit(0.0)
    cutoffs = risk_cutoffs(held.filter("half = 1").withColumn("score", worst), limit, delta).checkpoint()
    return stats, worst, cutoffs


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.03, delta: float = 0.05, quantile: float = 0.99, seed: int = 17) -> DataFrame:
    """Base counts and a verdict for each row of docs.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, stratum, score, cutoff (null where none is certified).  labels: doc_id, quality (1
    good, 0 bad; others and nulls ignored; the worst of repeated labels counts).  Null text is
    empty; rows with a null doc_id have no label; repeated rows each get a row.  Without
    labels every document that passes the base rules is kept.
    """
    stats, worst, cutoffs = _calibrated(docs, labels, stratum, limit, delta, quantile, seed)
    out = B.with_small(stats.withColumn("score", worst), cutoffs, "stratum")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _kept().alias("kept"), "stratum", "score", "cutoff")


def good_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.03, delta: float = 0.05, quantile: float = 0.99, seed: int = 17) -> DataFrame:
    """The rows and columns of docs that quality_verdicts() keeps; texts are not shuffled."""
    _, worst, cutoffs = _calibrated(docs, labels, stratum, limit, delta, quantile, seed)
    out = B.with_small(text_counts(docs, stratum, carry=True).withColumn("score", worst), cutoffs, "stratum").filter(_kept())
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
