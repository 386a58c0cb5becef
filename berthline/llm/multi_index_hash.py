"""Nearest neighbours by inner product through a multi-index over learned binary codes.

Vectors get a further entry that makes their lengths equal, so that the largest inner product is
the smallest angle. Rotations learnt on a sample (iterative quantisation) turn them into codes of
BITS signs. A code is split into substrings of SUB_BITS bits, and each scan block has an index per
substring from values to rows. A code within r bits of a query's has a substring within r // m bits
(m substrings; within one less beyond the first r % m + 1 of them), so probing the values in those
small balls finds every code within the radius. What is found is held against the radius with the whole code, then
ranked by the inner product of the original vectors.

The radius is learnt as well: it is the least one that holds RECALL of the true
neighbours of a few probe queries, which are compared with all rows. Queries that find too few
rows within it are asked again with a larger one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.llm.vectors import finite, matrix, usual_length
from berthline.session import scratch_path, store

#: Bits of a code, and of the substrings that are indexed.
BITS, SUB_BITS = 128, 8
#: Rows that the rotations are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 8192, 30
#: Probe queries for the radius, and the share of their true neighbours that it must hold.
PROBES, RECALL = 128, 0.97
#: Neighbours returned.
NEAREST = 20
#: Queries that are sent to the tasks at a time.
BLOCK = 16_384
SEED = 13

SUBS = BITS // SUB_BITS
FOUND = "q int, vec_id bigint, score double"


@dataclass
class Coder:
    """Centre, length and rotations of the codes. ``rotation`` has one column for each bit."""

    centre: np.ndarray
    length: float
    rotation: np.ndarray

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes of rows as 8-bit substrings. Queries have no further entry, and their length does not matter."""
        square = (x * x).sum(axis=1)
        if query:
            x, rest = x * (self.length / np.sqrt(square))[:, None], np.zeros(len(x))
        else:
            rest = np.sqrt(np.maximum(self.length**2 - square, 0))
        whole = np.column_stack([x, rest]) - self.centre
        return np.packbits(whole @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, length: float) -> Coder:
    """Rotations that bring the sample's principal coordinates close to the corners of a cube."""
    rng = np.random.default_rng(SEED)
    rest = np.sqrt(np.maximum(length**2 - (sample * sample).sum(axis=1), 0))
    whole = np.column_stack([sample, rest])
    centre = whole.mean(axis=0)
    _, _, axes = np.linalg.svd(whole - centre, full_matrices=False)
    axes = axes[: min(BITS, sample.shape[1])].T
    flat, turns = (whole - centre) @ axes, []
    while sum(t.shape[1] for t in turns) < BITS:
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        turns.append(axes @ turn)
    return Coder(centre, length, np.hstack(turns)[:, :BITS])


def _balls() -> list[np.ndarray]:
    """For each radius the differences of substrings within it."""
    weights = np.bitwise_count(np.arange(1 << SUB_BITS, dtype=np.uint16))
    return [np.flatnonzero(weights <= r) for r in range(SUB_BITS + 1)]


class MultiIndex:
    """Rows of a block by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = codes.view(np.uint64)
        self.rows = [np.argsort(codes[:, s], kind="stable") for s in range(SUBS)]
        self.starts = [
            np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << SUB_BITS))]) for s in range(SUBS)
        ]
        self.balls = _balls()

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits."""
        each, over = divmod(radius, SUBS)
        met = np.zeros(len(self.codes), dtype=bool)
        for s in range(SUBS):
            near = each if s <= over else each - 1
            if near < 0:
                continue
            values = self.balls[min(near, SUB_BITS)] ^ int(code[s])
            first, size = self.starts[s][values], self.starts[s][values + 1] - self.starts[s][values]
            if (total := int(size.sum())):
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(total)
                met[self.rows[s][at]] = True
        found = np.flatnonzero(met)
        far = np.bitwise_count(self.whole[found] ^ code.view(np.uint64)).sum(axis=1)
        return found[far <= radius]


def products(columns: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of a query with rows (columns of ``columns``), added entry by entry, so equal rows score equally."""
    parts = np.take(columns, rows, axis=1) * query[:, None]
    total = parts[0].copy()
    for part in parts[1:]:
        total += part
    return total


class Nearest:
    """The best rows of each query so far: largest score first, then smallest id, null last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, dtype=np.int64)] * queries
        self.none = [np.zeros(0, dtype=bool)] * queries
        self.scores = [np.zeros(0)] * queries

    def add(self, q: int, ids: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            ids, none, scores = ids[keep], none[keep], scores[keep]
        ids, none = np.concatenate([self.ids[q], ids]), np.concatenate([self.none[q], none])
        scores = np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.ids[q], self.none[q], self.scores[q] = ids[order], none[order], scores[order]

    def batch(self) -> pa.RecordBatch:
        number = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(i) for i in self.ids])
        return pa.RecordBatch.from_arrays([
            pa.array(number), pa.array(np.concatenate(self.ids), pa.int64(), mask=np.concatenate(self.none)),
            pa.array(np.concatenate(self.scores)),
        ], ["q", "vec_id", "score"])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    none = np.asarray(column.is_null())
    return column.fill_null(0).to_numpy(zero_copy_only=False), none


def _scan(rows: DataFrame, dims: int, queries: list, picker: Callable) -> DataFrame:
    """(q, vec_id, score): the best rows of every scan task for each of ``queries`` (_id, _vec), a block of them.

    ``picker(batch)`` gives for a batch of ``rows`` a function from the number of a query to row numbers.
    """
    asked = rows.sparkSession.sparkContext.broadcast((
        np.array([q._id for q in queries], dtype=np.int64), np.array([q._vec for q in queries], dtype=np.float64),
    ))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = asked.value
        best = Nearest(len(own), NEAREST)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, none = _ids(batch.column("_id"))
            columns = np.ascontiguousarray(matrix(batch.column("_vec"), dims).T)
            pick = picker(batch)
            for q in range(len(own)):
                found = pick(q)
                found = found[(ids[found] != own[q]) | none[found]]
                if len(found):
                    best.add(q, ids[found], none[found], products(columns, found, vectors[q]))
        yield best.batch()

    return rows.mapInArrow(search, FOUND)


def _merged(found: DataFrame, key: str = "q") -> DataFrame:
    """The NEAREST best of each query, ranked."""
    order = W.partitionBy(key).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEAREST)


def learn_radius(rows: DataFrame, dims: int, probes: list, coder: Coder) -> int:
    """The least radius that holds RECALL of the true neighbours of the probes, by comparing those with all rows."""
    def everything(batch: pa.RecordBatch):
        all_rows = np.arange(batch.num_rows)
        return lambda q: all_rows

    true = _merged(_scan(rows.select("_id", "_vec"), dims, probes, everything)).select("q", "vec_id")
    wanted = rows.join(F.broadcast(true), F.col("_id").eqNullSafe(F.col("vec_id"))).select("q", "_code").collect()
    if not wanted:
        return BITS
    codes = coder.codes(np.array([p._vec for p in probes], dtype=np.float64), query=True)
    theirs = np.frombuffer(b"".join(bytes(r._code) for r in wanted), dtype=np.uint8).reshape(len(wanted), SUBS)
    apart = np.bitwise_count(codes[[r.q for r in wanted]] ^ theirs).sum(axis=1)
    return int(np.sort(apart)[int(np.ceil(RECALL * len(apart))) - 1])


def _within(queries: list, coder: Coder, radius: int) -> Callable:
    """Picker of the rows within ``radius`` bits of a query, through the index of the batch."""
    codes = coder.codes(np.array([q._vec for q in queries], dtype=np.float64), query=True)

    def picker(batch: pa.RecordBatch):
        packed = np.frombuffer(b"".join(batch.column("_code").to_pylist()), dtype=np.uint8)
        index = MultiIndex(packed.reshape(batch.num_rows, SUBS))
        return lambda q: index.within(codes[q], radius)

    return picker


def search(rows: DataFrame, dims: int, queries: DataFrame, coder: Coder, radius: int) -> DataFrame:
    """query_id, rank, vec_id and score of the NEAREST rows within ``radius`` bits of each of ``queries`` (_q, _id, _vec).

    Queries go to the scan tasks block by block; ``_q`` tells apart queries of one id. Those with
    fewer results than there are rows for them are asked again with twice the radius.
    """
    spark, total = rows.sparkSession, rows.count()
    path = scratch_path(spark, "nearest")
    schema = "_q bigint, query_id bigint, rank int, vec_id bigint, score double"
    blocks = max(1, -(-queries.count() // BLOCK))
    parted = store(queries.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")), "queries")
    for block in range(blocks):
        asked, reach = parted.filter(F.col("_block") == block).orderBy("_q").collect(), radius
        while asked:
            found = _merged(_scan(rows, dims, asked, _within(asked, coder, reach)))
            names = spark.createDataFrame([(i, q._q, q._id) for i, q in enumerate(asked)], "q int, _q bigint, query_id bigint")
            found = store(found.join(names, "q").select("_q", "query_id", "rank", "vec_id", "score"), "block")
            few = {q._q: q for q in asked} if reach < BITS else {}
            if few:
                counts = {r._q: r.n for r in found.groupBy("_q").agg(F.count(F.lit(1)).alias("n")).collect()}
                few = {k: q for k, q in few.items() if counts.get(k, 0) < min(NEAREST, total - 1)}
            found.filter(~F.col("_q").isin(list(few))).write.mode("append").parquet(path)
            asked, reach = list(few.values()), min(BITS, 2 * max(reach, 1))
    written = spark.createDataFrame([], schema) if queries.isEmpty() else spark.read.schema(schema).parquet(path)
    return written.drop("_q")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the NEAREST rows by inner product of each row where ``is_query`` (on _id) holds.

    A query's own row is left out, as are other rows of its id. Ties go to the smaller vec_id, a
    null one last; a null id is never a query. Of rows that repeat an id and a vector, all are candidates and one is a
    query. Vectors that are null, zero, empty or hold null or non-finite entries, and those of
    another length than most, take no part. A query without candidates has no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).alias("_vec"))
    rows = rows.filter(finite(F.col("_vec"))).filter(F.exists("_vec", lambda x: x != 0))
    dims = usual_length(rows, "_vec")
    rows = store(rows.filter(F.size("_vec") == dims), "vectors")
    spark = rows.sparkSession
    order = F.xxhash64("_id", "_vec", F.lit(SEED))
    sample = rows.select("_id", "_vec").orderBy(order, "_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    square = F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    length = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    coder = learn(np.array([r._vec for r in sample], dtype=np.float64), length)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = coder.codes(matrix(batch.column("_vec"), dims)) if batch.num_rows else np.zeros((0, SUBS), np.uint8)
            yield batch.append_column("_code", pa.array([c.tobytes() for c in codes], pa.binary()))

    kind = rows.schema["_vec"].dataType.simpleString()
    coded = store(rows.mapInArrow(encode, f"_id bigint, _vec {kind}, _code binary"), "codes")
    probes = [r for r in sample if r._id is not None][:PROBES]
    radius = learn_radius(coded, dims, probes, coder) if probes else BITS
    queries = coded.filter(F.col("_id").isNotNull() & is_query).select("_id", "_vec").distinct()
    return search(coded, dims, queries.withColumn("_q", F.xxhash64("_id", "_vec")), coder, radius)


def nearest_of_every_20th(vectors: DataFrame) -> DataFrame:
    """The neighbours of every row whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("_id") % 20 == 0)
