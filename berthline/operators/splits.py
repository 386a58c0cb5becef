"""Exact, repeatable splits and feature scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.functions.numeric import LEHMER_MODULUS, lehmer
from berthline.operators.skew import free_nulls, hold_nulls, integer_bucket, ordered_rank, running_totals
from berthline.session import store

SPLIT_BUCKETS = 65536


def stratified_split(
    df: DataFrame, label: str, row_id: str, share: float = 0.2, seed: int = 42, buckets: int = SPLIT_BUCKETS
) -> DataFrame:
    """Mark ``round(share * n)`` rows of every class as validation (column ``is_val``).

    Rows are ordered by a hash of their id. Hash buckets are counted per class; only the
    single bucket in which the cut falls has its rows ranked. Rows without a label are a class
    of their own.
    """
    width = LEHMER_MODULUS // buckets + 1
    keyed = hold_nulls(df, [label]).withColumn("_h", lehmer(F.col(row_id), seed)).withColumn(
        "_b", integer_bucket(F.col("_h"), width)
    )
    counted = store(keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")), "bucket-counts")
    upto = running_totals(counted, [label], "_b", {"_upto": "_n"}, integer_bucket(F.col("_b"), 256))
    wanted = counted.groupBy(label).agg(F.round(F.sum("_n") * F.lit(share)).cast("bigint").alias("_want"))
    cut = upto.join(wanted, label).filter(F.col("_upto") >= F.col("_want")).groupBy(label).agg(
        F.min_by(F.struct("_b", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left")), F.col("_b")).alias("_c")
    )
    cuts = cut.select(label, F.col("_c._b").alias("_cut"), F.col("_c._left").alias("_left"))
    # one row per class of a 0/1 label, hence safe to broadcast
    marked = keyed.join(F.broadcast(cuts), label)
    away = marked.filter(F.col("_b") != F.col("_cut")).withColumn("is_val", F.col("_b") < F.col("_cut"))
    place = F.row_number().over(W.partitionBy(label).orderBy("_h", row_id))
    edge = marked.filter(F.col("_b") == F.col("_cut")).withColumn("is_val", place <= F.col("_left"))
    return free_nulls(away.unionByName(edge), [label]).select(*df.columns, "is_val")


def random_split(df: DataFrame, row_id: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark about ``share`` of the rows as validation, regardless of class."""
    return df.withColumn("is_val", lehmer(F.col(row_id), seed) < F.lit(int(share * LEHMER_MODULUS)))


def assign_folds(df: DataFrame, label: str, row_id: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Fold number that deals the rows of each class out evenly, in hash order of their ids."""
    keyed = hold_nulls(df, [label]).withColumn("_h", lehmer(F.col(row_id), seed))
    width = LEHMER_MODULUS // SPLIT_BUCKETS + 1
    dealt = ordered_rank(keyed, [label], ["_h", row_id], integer_bucket(F.col("_h"), width), "_deal")
    return free_nulls(dealt, [label]).withColumn("fold", F.pmod(F.col("_deal"), F.lit(folds)).cast("int")).select(
        *df.columns, "fold"
    )


def scaling_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of every column, as one row."""
    return df.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    )


def standard_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, fitted on ``fit_on``; constant columns only lose their mean.

    The statistics are one row of numbers, so they travel as literals.
    """
    stats = scaling_stats(fit_on if fit_on is not None else df, columns).first()

    def scaled(c: str):
        mean, std = stats[f"{c}__mean"], stats[f"{c}__std"]
        return (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)

    return df.withColumns({c: scaled(c) for c in columns})
