"""Machine pools from presets and from custom specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.operators.skew import integer_bucket, ordered_rank, running_totals, spread
from berthline.schemas import SPEC_COLUMNS, SPEC_RANGES, presets

#: Machines of a request that one row lists.
CHUNK = 4096


def preset_lookup(requests: DataFrame) -> DataFrame:
    """Attach preset specs by preset name (the preset table has a fixed five rows)."""
    return requests.join(F.broadcast(presets(requests.sparkSession)), "preset")


def pool_sequence(machines: DataFrame, order: list[str], bucket) -> DataFrame:
    """Running number over the whole pool, counted bucket by bucket."""
    return ordered_rank(machines, [], order, bucket, "seq")


def build_pool(requests: DataFrame, order: str = "request_id", per_bucket: int = 4096) -> DataFrame:
    """One machine per requested unit, named ``preset-N`` with N counted over the pool.

    ``requests`` has request_id (its order), preset and count. The units before a request are
    added up over the requests, so no unit is ranked. A request becomes rows of at most CHUNK
    units that are dealt out over the tasks before its machines are listed.
    """
    asked = preset_lookup(requests).filter("count >= 1").withColumn("_n", F.col("count").cast("bigint"))
    placed = running_totals(asked, [], order, {"_upto": "_n"}, integer_bucket(F.col(order), per_bucket))
    chunks = placed.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK})")))
    dealt = spread(chunks, [order, "_chunk"]).withColumn(
        "_unit", F.explode(F.expr(f"sequence(_chunk * {CHUNK} + 1, least((_chunk + 1) * {CHUNK}, _n))"))
    )
    numbered = dealt.withColumn("seq", F.col("_upto") - F.col("_n") + F.col("_unit"))
    return numbered.select(
        F.col("seq").cast("bigint").alias("machine_id"),
        F.format_string("%s-%d", F.col("preset"), F.col("seq")).alias("machine_name"),
        *SPEC_COLUMNS,
    )


def validate_specs(specs: DataFrame) -> DataFrame:
    """Reasons why each custom spec is out of range (empty array: valid), and its default name."""
    checks = [
        F.when(F.col(c).isNull() | ~F.col(c).between(F.lit(low), F.lit(high)), F.lit(f"{c} outside {low}..{high}"))
        for c, (low, high) in SPEC_RANGES.items()
    ]
    named = specs.withColumn("reasons", F.array_compact(F.array(*checks)))
    default = F.format_string("Custom-%d", F.col("machine_id"))
    return named.withColumn("machine_name", F.coalesce("machine_name", default))


def split_valid(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) custom specs."""
    checked = validate_specs(specs)
    ok = F.size("reasons") == 0
    return checked.filter(ok).drop("reasons"), checked.filter(~ok)


def add_machines(pool: DataFrame, more: DataFrame) -> DataFrame:
    return pool.unionByName(more)
