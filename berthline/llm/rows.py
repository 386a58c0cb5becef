"""Row identity, and orders over all rows in which no task sees more than a bucket."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.session import scratch_path

#: Buckets of an order for each shuffle partition.
BUCKETS = 4
#: Bits of a filter on hashes, 8 MB.
FILTER_BITS = 1 << 26
#: Bits of a filter that is a broadcast table, 262,144 numbers at most.
MARK_BITS = 1 << 24


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one, _doc, so that other columns cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def with_row_key(df: DataFrame) -> DataFrame:
    """_doc (all columns), _row, a hash of them, and _copy, which tells rows of one hash apart.

    Rows that are equal in all columns are numbered from 1; any two rows differ in
    (_row, _copy), and a second run finds the same pairs.
    """
    keyed = df.select(packed(df), F.xxhash64(*df.columns).alias("_row"))
    if keyed.groupBy("_row").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
        return keyed.withColumn("_copy", F.lit(1))
    return keyed.withColumn("_copy", F.row_number().over(W.partitionBy("_row").orderBy("_doc")))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs inside, so that batches of texts stay small."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def store_text(df: DataFrame, name: str) -> DataFrame:
    """Like ``berthline.session.store`` for tables that are mostly text: compressed harder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def probably_in(wanted: DataFrame, hash_col: str, probe: str) -> Column:
    """Whether hash ``probe`` may be among the hashes of ``wanted``: never wrongly false.

    Keeps rows out of a shuffle. The hashes are marked in FILTER_BITS bits, so what is sent
    to the tasks has a fixed size; the more hashes, the more rows pass.
    """
    slot = F.pmod(F.col(hash_col), F.lit(FILTER_BITS)) + 1  # bitmap buckets count from 1
    marks = (
        wanted.select(slot.alias("s"))
        .groupBy(F.bitmap_bucket_number("s").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    )
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in marks:
        own = np.frombuffer(bytes(r.m), dtype=np.uint8)
        start = (r.b - 1) * len(own)
        bits[start : start + len(own)] |= own
    table = wanted.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def marked(hashes: pa.Array) -> pa.Array:
        s = np.mod(hashes.to_numpy(zero_copy_only=False).astype(np.int64), FILTER_BITS)
        return pa.array((table.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1, pa.bool_())

    return marked(F.col(probe))


def keep_marked(df: DataFrame, probe: str, wanted: DataFrame, hash_col: str) -> DataFrame:
    """The rows of ``df`` whose 64-bit hash ``probe`` may be among those of ``wanted``, by DataFrame functions only.

    Like ``probably_in``, with MARK_BITS bits as a broadcast table of at most MARK_BITS / 64 numbers.
    """
    slot = F.pmod(F.col(hash_col), F.lit(MARK_BITS))
    marks = wanted.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63L AS int))")).alias("_marks")
    )
    asked = df.withColumn("_probe", F.pmod(F.col(probe), F.lit(MARK_BITS)))
    joined = asked.join(F.broadcast(marks), F.shiftright("_probe", 6) == F.col("_word"))
    return joined.filter(F.expr("getbit(_marks, cast(_probe & 63L AS int)) = 1")).select(*df.columns)


def bucket_count(df: DataFrame) -> int:
    return BUCKETS * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unit(h: Column) -> Column:
    """A signed 64-bit hash as a number in (0, 1), non-decreasing in the hash."""
    return (F.shiftright(h, 32).cast("double") + F.lit(float(1 << 31)) + F.lit(0.5)) / F.lit(float(1 << 32))


def sum_before(
    rows: DataFrame, keys: list[str], bucket: str, order: list, value: Column, name: str
) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each one, per key along (bucket, order).

    Buckets are summed first; a task then only orders the rows of single buckets, whatever
    share of the rows a key has. ``rows`` is read twice and should be a stored table.
    """
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    along = W.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    offsets = sums.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_keyb"),
        (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"),
    )
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = rows.withColumn("_inside", F.sum(value).over(inside) - value)
    same = F.col(bucket) == F.col("_keyb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return within.join(offsets, same).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))
