"""Whitening of vectors through the singular values of their centred rows.

Spark reduces the centred rows block by block to one triangular R (a QR of each block stacked under
the R so far, then of stacked R's); R has as many rows and columns as a vector has entries. R is made
bidiagonal, dqds finds its singular values and twisted factorisations its right singular vectors, which
are the eigenvectors of the covariance. The covariance itself is never formed.

Entries are whole numbers, floor(SCALE * c) + SHIFT, so sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.llm.bidiagonal import eigenpairs
from berthline.llm.vectors import finite, matrix, usual_length
from berthline.session import store

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components kept.
COMPONENTS = 32
#: Triangular factors that one task stacks.
FAN = 32
#: Eigenvalues up to this share of the largest count as zero: rounding alone.
RANK = 1e-22
#: Rows of output that a step makes at a time, before they are repeated for each component.
ROWS = 2048

_LONG = 1 << 63


@dataclass
class Whitening:
    """Exact counts and sums of the fitted rows, eigenvalues of their covariance, and kept components as columns."""

    n: int
    sums: list[int]
    most: int
    values: np.ndarray
    kept: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.kept / self.values.sum()

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers, or Python's where those could overflow."""
        if (self.most + 1) * self.n < _LONG // 4:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.kept)


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    return np.floor(matrix(column, dims) * SCALE).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(_id, _vec) of the rows that take part, and the length of their vectors."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")).filter(finite(F.col("_vec")))
    fitting = rows.filter(F.forall("_vec", lambda x: F.abs(x.cast("double") * SCALE) < F.lit(float(1 << 62))))
    dims = usual_length(fitting, "_vec")
    return fitting.filter(F.size("_vec") == dims), dims


def _totals(rows: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Row count, exact sum of each entry, and the largest entry's size."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, most = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(0), dims)
                n, most = n + len(x), max(most, int(np.abs(x).max()))
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({
                "n": [n] * dims, "most": [most] * dims, "at": np.arange(dims, dtype=np.int32), "low": low, "high": high,
            })

    found = rows.select("_vec").mapInArrow(parts, "n bigint, most bigint, at int, low bigint, high bigint")
    wide = "decimal(38,0)"
    sums = found.groupBy("at").agg(
        F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("low").cast(wide)).alias("low"),
        F.sum(F.col("high").cast(wide)).alias("high"),
    ).orderBy("at").collect()
    return (
        (sums[0].n, [(int(r.high) << 32) + int(r.low) for r in sums], max(r.most for r in sums)) if sums else (0, [], 0)
    )


def _triangle(rows: DataFrame, dims: int, model: Whitening) -> np.ndarray:
    """R of the centred rows: one per scan task, then of stacked ones until a single one is left."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack([r, model.centred(_whole(batch.column(0), dims))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def stacked(table: pa.Table) -> pa.Table:
        r = np.zeros((0, dims))
        for one in table.column("r"):
            r = np.linalg.qr(np.vstack([r, one.values.to_numpy().reshape(-1, dims)]), mode="r")
        return pa.table({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    kind = "r array<double>"
    factors = store(
        rows.select("_vec").mapInArrow(blocks, kind).select("r", F.spark_partition_id().alias("_at")), "triangles"
    )
    last = factors.agg(F.max("_at")).first()[0]
    while last:
        groups = factors.withColumn("_group", (F.col("_at") / FAN).cast("int"))
        merged = groups.groupBy("_group").applyInArrow(lambda key, t: stacked(t).append_column(
            "_at", pa.array([key[0].as_py()], pa.int32())), f"{kind}, _at int")
        factors = store(merged, "triangles")
        last //= FAN
    r = np.array(factors.first().r).reshape(-1, dims)
    return np.vstack([r, np.zeros((dims - len(r), dims))])


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (_vec, all of length ``dims``); None without rows."""
    n, sums, most = _totals(rows, dims)
    if not n:
        return None
    none = np.zeros(0)
    model = Whitening(n, sums, most, none, none, np.zeros((dims, 0)))
    values, kept, vectors = eigenpairs(_triangle(rows, dims, model), components, RANK)
    return Whitening(n, sums, most, values / n, kept / n, vectors)


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, from the rows themselves."""
    k = len(model.kept)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(_whole(batch.column(0), dims))
                total += w.sum(axis=0)
                products += w.T @ w
        both = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(both), dtype=np.int32), "v": both})

    summed = rows.select("_vec").mapInArrow(parts, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.array([r.v for r in summed.orderBy("at").collect()]) / model.n
    mean, products = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whitening_report(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Every usable row in whitened coordinates.

    Returns vec_id, component (from 1, by falling eigenvalue), n, deviation (exact sum of (n * x - S)^2;
    null where it exceeds a long), whitened, explained (share of the trace) and identity_error (one value).
    Left out are vectors that are null, empty or hold null or non-finite entries or entries too large for a long, and vectors
    of another length than most. Rows that repeat an id or a vector all count. Components without variance are
    left out, as they cannot be scaled to one; so rows that are all equal, or a single one, give nothing.
    """
    rows, dims = usable(vectors, id_col, vec_col)
    rows = store(rows, "vectors")
    model = fit(rows, dims, components)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if model is None or not len(model.kept):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, dims, model), len(model.kept)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                x, m = _whole(part.column(1), dims), part.num_rows
                off = model.deviations(x)
                if int(np.abs(off).max()) ** 2 * dims < _LONG:
                    squares = list((off * off).sum(axis=1))
                else:
                    squares = [s if s < _LONG else None for s in (off.astype(object) ** 2).sum(axis=1)]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([None if s is None else int(s) for s in squares], pa.int64()).take(
                        pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("_id", "_vec").mapInArrow(report, schema)
