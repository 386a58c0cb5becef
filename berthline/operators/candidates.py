"""Matching requests to machines that can hold them.

Tasks with equal requests see equal candidates, and machines with equal totals and usage
score equally. Matching therefore runs on distinct request shapes and machine classes,
whose number depends on the variety of the data and not on its volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.functions import scoring
from berthline.functions.numeric import coalesce_zero
from berthline.operators.skew import salted_join, spread
from berthline.schemas import (
    DEFAULT_CPU_POWER_W, DEFAULT_GPU_POWER_W, FEATURE_COLUMNS, MACHINE_COLUMNS, REMAINING, REQUEST_COLUMNS,
    REQUESTS, RESOURCES, TOTALS, USED, require_columns,
)

BLOCK_RESOURCES = ("gpu", "ram")
BLOCK_SALTS = 8


POWER_COLUMNS = ("current_cpu_power_w", "current_gpu_power_w")


def with_remaining(machines: DataFrame) -> DataFrame:
    """Total minus used for the four resources."""
    return machines.withColumns({REMAINING[r]: F.expr(f"{TOTALS[r]} - {USED[r]}") for r in RESOURCES})


def fill_requests(tasks: DataFrame) -> DataFrame:
    """Absent requests count as 0."""
    return tasks.withColumns(
        {c: coalesce_zero(c) if c in tasks.columns else F.lit(0.0) for c in REQUEST_COLUMNS}
    )


def request_shapes(tasks: DataFrame) -> DataFrame:
    """Distinct request tuples with the number of tasks that ask for them."""
    return fill_requests(tasks).groupBy(*REQUEST_COLUMNS).agg(F.count(F.lit(1)).alias("n_tasks"))


def machine_states(machines: DataFrame, power: bool = True) -> DataFrame:
    """Machines with what tells them apart: spec, usage and, unless nothing reads it, the current draw."""
    require_columns(machines, MACHINE_COLUMNS, "machine snapshot")
    read = [c for c in MACHINE_COLUMNS if power or c not in POWER_COLUMNS]
    return machines.withColumns({c: coalesce_zero(c) if c in read else F.lit(0.0) for c in MACHINE_COLUMNS})


def machine_classes(machines: DataFrame, power: bool = True) -> DataFrame:
    """Distinct (spec, usage, power) states: smallest machine id, member count, remaining capacity."""
    grouped = machine_states(machines, power).groupBy(*MACHINE_COLUMNS).agg(
        F.min("machine_id").alias("class_id"), F.count(F.lit(1)).alias("n_machines")
    )
    return with_remaining(grouped)


def _step(amount: str) -> str:
    """Coarse size step of an amount: 0 for nothing, then one step per factor of four."""
    return f"CASE WHEN {amount} <= 0 THEN 0 ELSE greatest(1, 1 + CAST(ceil(log(4.0D, {amount})) AS INT)) END"


def capable_pairs(
    shapes: DataFrame, classes: DataFrame, eps: float = scoring.EPS, salts: int = BLOCK_SALTS
) -> DataFrame:
    """Every (request shape, machine class) pair with enough remaining capacity.

    An inequality join would scan all classes for each shape. Here a class is listed under
    every size step it can serve and a shape under its own step, so Spark sees an equi-join
    that only meets classes large enough in the blocking resources; the exact test follows.
    Shapes of a crowded step are spread by salt. The short shape list is dealt out over all
    tasks explicitly: judged by its bytes alone it would end up in one, with all the pairs.
    """
    keys = {f"_step_{r}": r for r in BLOCK_RESOURCES}
    asked = spread(shapes, REQUEST_COLUMNS).withColumns({k: F.expr(_step(REQUESTS[r])) for k, r in keys.items()})
    offered = classes
    for k, r in keys.items():
        offered = offered.withColumn(k, F.expr(f"explode(sequence(0, {_step(f'({REMAINING[r]} + {eps!r}D)')}))"))
    if salts > 1:
        asked = asked.withColumn("_salt", F.expr(f"CAST(pmod(xxhash64({', '.join(REQUEST_COLUMNS)}), {salts}) AS INT)"))
        offered = offered.withColumn("_salt", F.expr(f"explode(sequence(0, {salts - 1}))"))
        keys["_salt"] = ""
    return asked.join(offered, list(keys)).filter(scoring.fits(eps)).drop(*keys)


def feasible_counts(tasks: DataFrame, machines: DataFrame, eps: float = scoring.EPS) -> DataFrame:
    """Per task, the number of machines whose remaining capacity covers its request."""
    shapes = request_shapes(tasks).drop("n_tasks")
    counts = (
        capable_pairs(shapes, machine_classes(machines), eps)
        .groupBy(*REQUEST_COLUMNS)
        .agg(F.sum("n_machines").alias("n_feasible"))
    )
    return (
        salted_join(fill_requests(tasks), counts, REQUEST_COLUMNS, ["task_id"], "left")
        .withColumn("n_feasible", F.coalesce("n_feasible", F.lit(0)).cast("bigint"))
    )


def assemble_features(
    pairs: DataFrame, constant_power: bool = False,
    cpu_power_w: float = DEFAULT_CPU_POWER_W, gpu_power_w: float = DEFAULT_GPU_POWER_W,
) -> DataFrame:
    """The 16 model inputs as doubles; power comes from the snapshot or from the constants."""
    power = {"current_cpu_power_w": F.lit(cpu_power_w), "current_gpu_power_w": F.lit(gpu_power_w)}
    values = {
        c: power[c] if c in power and (constant_power or c not in pairs.columns) else F.col(c).cast("double")
        for c in FEATURE_COLUMNS
    }
    return pairs.withColumns(values)


def align_features(df: DataFrame, wanted: list[str], keep: list[str] = ()) -> DataFrame:
    """The model's own column order; absent columns become 0."""
    return df.select(
        *keep, *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in wanted]
    )
