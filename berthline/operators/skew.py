"""Joins and running totals that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_SALTS = 8


def spread(df: DataFrame, columns: list[str], hashed: bool = True) -> DataFrame:
    """Deal a short frame out over all tasks, for steps that multiply its rows.

    Keyed by a hash of the columns: partitioning by the columns themselves would count as
    given after a grouping, and that grouping's exchange may be merged into one partition.
    Two frames that are joined on the columns next are dealt out by the columns (not ``hashed``).
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = [F.xxhash64(*columns)] if hashed else [F.col(c) for c in columns]
    return df.repartition(width, *by)


def hold_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its keys wrapped so that a null key equals itself in joins; ``free_nulls`` unwraps them."""
    return df.withColumns({k: F.struct(F.col(k).alias("v")) for k in keys}) if keys else df


def free_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({k: F.col(k)["v"] for k in keys}) if keys else df


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Equi-join whose left rows of one key are spread over ``salts`` groups.

    ``right`` holds few rows per key and is repeated once per salt. The salt comes from
    ``spread`` columns, not from a random number, so a recomputed task joins the same rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def running_totals(
    df: DataFrame, keys: list[str], order: str, totals: dict[str, str], buckets: Column | list[Column],
    following: str | None = None,
) -> DataFrame:
    """Inclusive running sums of ``totals`` (new name -> column) per key along ``order``.

    Sums per bucket are accumulated first, then rows within each bucket. One key may hold
    any share of the rows; a single task only sees one bucket, or the short list of a key's
    buckets. ``df`` is unique on (keys, order). ``buckets`` are non-decreasing in ``order``
    and never null, from fine to coarse; each must follow from the one before it. Several
    levels keep every list short when values crowd into a few coarse buckets. Keys that may
    be null go through ``hold_nulls`` first.
    ``following`` names a column for the next row's order value.
    """
    levels = buckets if isinstance(buckets, list) else [buckets]
    lead = (following, order) if following else None
    before = _totals_before(df, keys, order, {f"_before_{n}": c for n, c in totals.items()}, levels, lead)
    return before.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.col(c)).alias(n) for n, c in totals.items()],
        *([following] if following else []),
    )


def _totals_before(
    df: DataFrame, keys: list[str], order: str, totals: dict[str, str], levels: list[Column],
    lead: tuple[str, str] | None,
) -> DataFrame:
    """Sums over the rows before each row, and the next row's value of a column."""
    depth = len(levels)
    bucket = f"_bucket{depth}"
    rows = df.withColumn(bucket, levels[0]) if levels else df
    partition = [F.col(k) for k in keys] + ([F.col(bucket)] if levels else [])
    along = W.partitionBy(*(partition or [F.lit(0)])).orderBy(order)
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    within = {n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in totals.items()}
    if not levels:
        columns = [c.alias(n) for n, c in within.items()]
        return df.select("*", *columns, *([F.lead(lead[1]).over(along).alias(lead[0])] if lead else []))
    rows = rows.withColumns({f"_up{depth}_{i}": c for i, c in enumerate(levels[1:])})
    upper = [f"_up{depth}_{i}" for i in range(depth - 1)]
    sums = rows.groupBy(*keys, bucket, *upper).agg(
        *[F.sum(c).alias(f"_sum{depth}_{n}") for n, c in totals.items()],
        *([F.min(lead[1]).alias(f"_first{depth}")] if lead else []),
    )
    offsets = _totals_before(
        sums, keys, bucket, {f"_offset{depth}_{n}": f"_sum{depth}_{n}" for n in totals},
        [F.col(u) for u in upper], (f"_next{depth}", f"_first{depth}") if lead else None,
    ).select(*keys, bucket, *[f"_offset{depth}_{n}" for n in totals], *([f"_next{depth}"] if lead else []))
    return rows.join(offsets, [*keys, bucket]).select(
        *df.columns,
        *[(F.col(f"_offset{depth}_{n}") + c).alias(n) for n, c in within.items()],
        *([F.coalesce(F.lead(lead[1]).over(along), F.col(f"_next{depth}")).alias(lead[0])] if lead else []),
    )


def ordered_rank(
    df: DataFrame, keys: list[str], order: list[str], buckets: Column | list[Column], name: str = "rank"
) -> DataFrame:
    """1-based rank per key by ``order``, counted bucket by bucket; ``buckets`` as in running_totals."""
    levels = buckets if isinstance(buckets, list) else [buckets]
    rows = df.withColumn("_bucket", levels[0]).withColumns({f"_up_{i}": c for i, c in enumerate(levels[1:])})
    upper = [f"_up_{i}" for i in range(len(levels) - 1)]
    counts = rows.groupBy(*keys, "_bucket", *upper).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _totals_before(counts, keys, "_bucket", {"_before": "_n"}, [F.col(u) for u in upper], None)
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.join(offsets.select(*keys, "_bucket", "_before"), [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .select(*df.columns, name)
    )


def integer_bucket(value: Column, width: float) -> Column:
    """Index of a value among buckets of a width.

    Declared non-null, so that joins on it add no filter that would keep the two uses of
    the rows in a running total from sharing one exchange.
    """
    return F.coalesce(F.floor(value / F.lit(float(width))).cast("bigint"), F.lit(0).cast("bigint"))


def score_buckets(value: Column) -> list[Column]:
    """Two nested bucket levels for scores: crowded scores still spread over the fine one."""
    return [integer_bucket(value, 2.0**-30), integer_bucket(value, 2.0**-15)]
