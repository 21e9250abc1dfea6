"""Whitening of embeddings from a covariance found by polarisation.

Entries become integers, so every sum is exact.  One pass sums each dimension.  A second pass
centres each entry on its rounded mean and adds up the squares of every dimension and of the sum of
every two; cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, the rest of the centring being exact in
integers.  d * (d + 1) / 2 numbers reach the driver, whatever the number of rows, for eigh.  Rows
are projected where they are read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries beyond this, times `scale`, do not become integers of 64 bits and count as non-finite.
LARGEST = 2.0**60
_LIMB = 60


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x): floor(scale * c) + offset of every vector without null or non-finite entries."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    x = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter(F.size("v") > 0)
    x = x.filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) < LARGEST)))
    return x.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The arrays of column x, all of one length, as rows."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(numbers: DataFrame) -> tuple[int, int, list[int]]:
    """(dimensions, rows, sum of each dimension) of the commonest length; ties: the longest."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0)
            size = np.diff(x.offsets.to_numpy())
            flat, since = x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                y = flat[since[rows][:, None] + np.arange(d)]
                one = held.setdefault(d, [0, np.zeros(d, object), np.zeros(d, object)])
                one[0] += len(rows)
                one[1] += (y >> 31).sum(axis=0).astype(object)
                one[2] += (y & (1 << 31) - 1).sum(axis=0).astype(object)
        for d, (n, hi, lo) in held.items():
            whole = [Decimal(int(v)) for v in hi * 2**31 + lo]
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "k": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array(whole, pa.decimal128(38, 0))})

    table = numbers.select("x").mapInArrow(run, "d int, k int, n long, s decimal(38,0)").groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = table.filter("k = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not best:
        return 0, 0, []
    d = best[0]["d"]
    return d, best[0]["n"], [int(r["s"]) for r in table.filter(F.col("d") == d).orderBy("k").collect()]  # one row a dimension


def squares(y: np.ndarray) -> np.ndarray:
    """Exact sums over rows of (y_i + y_j)^2 for i < j and of y_i^2, as Python integers in row-major order of i <= j."""
    rows, d = y.shape
    out = np.zeros(d * (d + 1) // 2, object)
    size = np.abs(y).max(axis=1, initial=0)
    small = y[size < 1 << 24]
    parts = [small[k : k + 4096] for k in range(0, len(small), 4096)]  # 2^12 rows of 2^50 at most
    if len(small) < rows:
        parts.append(y[size >= 1 << 24].astype(object))
    for part in parts:
        t, at = np.ascontiguousarray(part.T), 0
        for i in range(d):
            two = t[i:] + t[i]
            s = (two * two).sum(axis=1)
            s[0] //= 4
            out[at : at + d - i] += s.astype(object)
            at += d - i
    return out


def _pair_sums(numbers: DataFrame, centre: np.ndarray) -> list[int]:
    """squares() of all rows less centre: a row for each pair leaves a task, in two limbs."""
    d = len(centre)

    def run(batches):
        total = np.zeros(d * (d + 1) // 2, object)
        for batch in batches:
            total += squares(_matrix(batch) - centre)
        hi, lo = zip(*(divmod(int(v), 1 << _LIMB) for v in total))
        limb = lambda v: pa.array([Decimal(x) for x in v], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(range(len(total)), pa.int64()), "hi": limb(hi), "lo": limb(lo)})

    sums = numbers.select("x").mapInArrow(run, "pair long, hi decimal(38,0), lo decimal(38,0)").groupBy("pair").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    out = [0] * (d * (d + 1) // 2)
    for r in sums.toLocalIterator():  # d * (d + 1) / 2 rows
        out[r["pair"]] = (int(r["hi"]) << _LIMB) + int(r["lo"])
    return out


def covariance(n: int, rest: list[int], pairs: list[int]) -> np.ndarray:
    """By polarisation: pairs are sums of squares about the rounded means, rest the sums about them."""
    d = len(rest)
    var = [[0] * d for _ in range(d)]  # of y_i + y_j, times n^2
    at = iter(pairs)
    for i in range(d):
        for j in range(i, d):
            s = rest[i] if i == j else rest[i] + rest[j]
            var[i][j] = n * next(at) - s * s
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * var[i][i] if i == j else var[i][j] - var[i][i] - var[j][j]
            out[i, j] = out[j, i] = twice / (2 * n * n)  # integers: rounded once
    return out


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns, the largest entry of each positive."""
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:most], p[:, ::-1][:, :most]
    return e, p * np.where(p[np.abs(p).argmax(axis=0), np.arange(p.shape[1])] < 0, -1.0, 1.0)


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact, from y = x - centre and rest = S - n * centre."""
    top = int(np.abs(y).max(initial=0))
    wide = y.astype(object) if top * top * y.shape[1] >= 1 << 62 or top * n * y.shape[1] >= 1 << 62 else y
    square, cross = (wide * wide).sum(axis=1).astype(object), (wide * rest.astype(wide.dtype)).sum(axis=1).astype(object)
    return (n * n * square - 2 * n * cross + sum(int(r) ** 2 for r in rest)).tolist()


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or empty, or hold a null, a non-finite entry or one beyond 2^60 / scale,
    are dropped, as are those of another length than the commonest (ties: the longest).  Repeated rows
    and null ids each stay.  A component without variance has null whitened values and is left out of
    identity_error, the largest entry of the whitened values' covariance less the identity (0 if there
    is none).  deviation is null where it exceeds a long.  Other columns are ignored.
    """
    numbers = _integers(vectors, id_col, vector_col, scale, offset)
    kind = numbers.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double"
    d, n, total = _sums(numbers)
    name = lambda df, error: df.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
    if not n:
        return name(vectors.sparkSession.createDataFrame([], schema), 0.0)
    numbers = numbers.filter(F.size("x") == d)
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre, rest = np.array(middle, np.int64), np.array([s - n * m for s, m in zip(total, middle)], np.int64)
    v = covariance(n, rest.tolist(), _pair_sums(numbers, centre))
    e, p = components_of(v, components)
    some = e > 1e-13 * max(float(e[0]), 0.0)
    turn = p / np.sqrt(np.where(some, e, 1.0))
    explained = np.where(some, e / (np.trace(v) or 1.0), 0.0)
    k = len(e)

    def project(y: np.ndarray) -> np.ndarray:
        return (y - rest / n) @ turn

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(_matrix(batch) - centre)
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k + k * k), pa.int32()), "s": pa.array(np.concatenate([first, second.reshape(-1)]))})

    sums = np.zeros(k + k * k)
    for r in numbers.select("x").mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # k + k^2 rows
        sums[r["at"]] = r["s"] / n
    off = np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k))[np.ix_(some, some)]

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                y = _matrix(part) - centre
                w, m = project(y), part.num_rows
                far = [x if x < 1 << 63 else None for x in deviations(y, n, rest)]
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(each)), pa.array(w.reshape(-1), mask=np.tile(~some, m)), pa.array(np.tile(explained, m)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained"])

    return name(numbers.mapInArrow(rows, schema), float(off.max(initial=0.0)))
