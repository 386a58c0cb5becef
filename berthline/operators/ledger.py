"""Cost, energy and usage per machine from an allocation ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.functions.numeric import coalesce_zero, ratio
from berthline.operators.occupancy import BUCKET_MS, usage_at, with_utilization
from berthline.operators.skew import integer_bucket, ordered_rank

from berthline.schemas import REQUEST_COLUMNS, REQUESTS, RESOURCES, SPEC_COLUMNS, TOTALS, USED

MS_PER_HOUR = 3_600_000.0
MISSING_DURATION_S = 1.0


def record_allocations(placements: DataFrame) -> DataFrame:
    """Ledger rows of scheduled tasks: [arrival, arrival + execution time).

    A task without an execution time holds its machine for one second.
    """
    seconds = F.coalesce(F.col("execution_time"), F.lit(MISSING_DURATION_S))
    return placements.filter(F.col("machine_id").isNotNull()).select(
        "task_id",
        "machine_id",
        F.col("arrival_ms").alias("start_ms"),
        (F.col("arrival_ms") + F.round(seconds * 1000).cast("bigint")).alias("finish_ms"),
        *[coalesce_zero(c).alias(c) for c in REQUEST_COLUMNS],
    )


def machine_ledger(allocations: DataFrame, machines: DataFrame) -> DataFrame:
    """Task count, cost and energy (Wh) booked per machine; unused machines show zeros.

    Cost and energy are linear in hours, so the ledger shrinks to one row per machine
    before it meets the specs.
    """
    hours = (F.col("finish_ms") - F.col("start_ms")) / F.lit(MS_PER_HOUR)
    booked = allocations.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum(hours).alias("hours"),
        F.sum(hours * coalesce_zero(REQUESTS["cpu"])).alias("_cpu_h"),
        F.sum(hours * coalesce_zero(REQUESTS["gpu"])).alias("_gpu_h"),
    )
    zero = F.lit(0.0)
    cpu = F.coalesce("_cpu_h", zero)
    gpu = F.coalesce("_gpu_h", zero)
    energy = ratio(cpu, F.col(TOTALS["cpu"])) * F.col("cpu_watts") + gpu / F.greatest(
        F.lit(1.0), F.col(TOTALS["gpu"])
    ) * F.col("gpu_watts")
    return machines.join(booked, "machine_id", "left").select(
        "machine_id",
        "machine_name",
        F.coalesce("n_tasks", F.lit(0)).cast("bigint").alias("n_tasks"),
        F.coalesce("hours", zero).alias("busy_hours"),
        (F.coalesce("hours", zero) * F.col("cost_per_hour")).alias("total_cost"),
        energy.alias("energy_wh"),
    )


def machine_snapshot(machines: DataFrame, allocations: DataFrame, at_ms: int) -> DataFrame:
    """The fleet at one instant: specs, usage, current draw, active tasks, booked cost and energy."""
    now = allocations.filter((F.col("start_ms") <= at_ms) & (F.col("finish_ms") > at_ms))
    usage = now.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("active_tasks"), *[F.sum(coalesce_zero(REQUESTS[r])).alias(USED[r]) for r in RESOURCES]
    )
    booked = machine_ledger(allocations.filter(F.col("start_ms") <= at_ms), machines).drop("machine_name")
    specs = machines.select("machine_id", "machine_name", *SPEC_COLUMNS)
    state = specs.join(usage, "machine_id", "left").withColumns(
        {USED[r]: F.coalesce(USED[r], F.lit(0.0)) for r in RESOURCES}
        | {"active_tasks": F.coalesce("active_tasks", F.lit(0)).cast("bigint")}
    )
    return with_current_power(state).join(booked, "machine_id")


def with_current_power(state: DataFrame) -> DataFrame:
    """Draw in proportion to the used share of CPU and GPU cores."""
    return state.withColumns(
        {
            "current_cpu_power_w": F.col("cpu_watts") * ratio(F.col(USED["cpu"]), F.col(TOTALS["cpu"])),
            "current_gpu_power_w": F.col("gpu_watts")
            * F.col(USED["gpu"]) / F.greatest(F.lit(1.0), F.col(TOTALS["gpu"])),
        }
    )


def used_from_free(df: DataFrame, free: dict[str, str]) -> DataFrame:
    """Used = total - free for each resource; ``free`` maps resource to its free column."""
    return df.withColumns({USED[r]: F.col(TOTALS[r]) - F.col(c) for r, c in free.items()})


def pool_view(snapshot: DataFrame) -> DataFrame:
    """Machine, capacity, CPU and RAM utilisation in percent, active tasks."""
    return snapshot.select(
        "machine_id", "machine_name", "cpu_cores_total", "ram_total_gb",
        (ratio(F.col(USED["cpu"]), F.col(TOTALS["cpu"])) * 100).alias("utilization_cpu"),
        (ratio(F.col(USED["ram"]), F.col(TOTALS["ram"])) * 100).alias("utilization_ram"),
        "active_tasks",
    )


def flatten_history(machines: DataFrame) -> DataFrame:
    """Nested samples (array column ``history``) as one row per machine and time."""
    return machines.select("machine_id", F.explode("history").alias("s")).select("machine_id", "s.*")


def unpivot_utilization(samples: DataFrame, ids: list[str]) -> DataFrame:
    """Wide samples to one row per resource, in percent."""
    renamed = samples.select(
        *ids, F.col("cpu_util").alias("CPU"), F.col("ram_util").alias("RAM"), F.col("gpu_util").alias("GPU")
    )
    long = renamed.unpivot(ids, ["CPU", "RAM", "GPU"], "resource", "utilization")
    return long.withColumn("utilization", F.col("utilization") * 100)


def latest_sample(samples: DataFrame, time: str = "time_ms") -> DataFrame:
    """The last sample of each machine; of several at one time, the one with the largest values."""
    values = [c for c in samples.columns if c not in ("machine_id", time)]
    last = F.max(F.struct(time, *values)).alias("_last")
    return samples.groupBy("machine_id").agg(last).select(
        "machine_id", *[F.col(f"_last.{c}").alias(c) for c in samples.columns if c != "machine_id"]
    )


def sample_ticks(
    ticks: DataFrame, allocations: DataFrame, machines: DataFrame, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """One utilisation sample per requested (machine, tick), before the tick's own allocations."""
    return with_utilization(usage_at(ticks, allocations, strict_start=True, bucket_ms=bucket_ms), machines)


def task_ordinal(
    tasks: DataFrame, arrival: str = "arrival_ms", task: str = "task_id", per_bucket: int = 100_000
) -> DataFrame:
    """1-based position of each task by arrival, then id.

    Counted per (instant, id range) within a day, so neither a busy day nor a busy instant
    ends up in one task.
    """
    fine = F.struct(F.col(arrival), integer_bucket(F.col(task), per_bucket).alias("part"))
    return ordered_rank(tasks, [], [arrival, task], [fine, integer_bucket(F.col(arrival), BUCKET_MS)], "task_ord")


def logical_arrival(tasks: DataFrame, interval_s: float = 1.0) -> DataFrame:
    """Arrival of the i-th task at (i - 1) * interval on the logical clock."""
    step = F.lit(int(round(interval_s * 1000)))
    return tasks.withColumn("arrival_ms", (F.col("task_ord") - 1) * step)
