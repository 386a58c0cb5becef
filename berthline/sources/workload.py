"""Synthetic workloads: three profiles of uniform requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berthline.functions.numeric import LEHMER_MODULUS, lehmer

# Inclusive request ranges per profile, video memory and duration ranges.
PROFILES = {
    "Light": {"cpu": (1, 4), "ram": (1, 8), "gpu": (0, 0)},
    "Mixed": {"cpu": (1, 8), "ram": (2, 16), "gpu": (0, 512)},
    "Heavy": {"cpu": (4, 16), "ram": (8, 64), "gpu": (0, 2048)},
}
VRAM_RANGE = (0, 15)
SECONDS_RANGE = (5, 60)


def _uniform(key: Column, stream: int, low: int, high: int) -> Column:
    return (F.lit(low) + F.pmod(lehmer(key, stream), F.lit(high - low + 1))).cast("double")


def request_columns(key: Column, profile: str = "Mixed", seed: int = 42) -> dict[str, Column]:
    """Requests drawn from an integer key; the same key gives the same request everywhere."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {sorted(PROFILES)}, not {profile!r}")
    ranges = PROFILES[profile]
    base = seed * 16
    has_gpu = ranges["gpu"][1] > 0
    low, high = SECONDS_RANGE
    share = lehmer(key, base + 4).cast("double") / F.lit(float(LEHMER_MODULUS))
    return {
        "req_cpu_cores": _uniform(key, base, *ranges["cpu"]),
        "req_gpu_cores": _uniform(key, base + 1, *ranges["gpu"]),
        "req_gpu_vram_gb": _uniform(key, base + 2, *VRAM_RANGE) if has_gpu else F.lit(0.0),
        "req_ram_gb": _uniform(key, base + 3, *ranges["ram"]),
        "execution_time": F.floor((F.lit(float(low)) + share * F.lit(float(high - low))) * 100 + 0.5) / F.lit(100.0),
    }


def generate_workload(spark: SparkSession, n: int, profile: str = "Mixed", seed: int = 42) -> DataFrame:
    """n tasks with ids 1..n."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "task_id")
    return ids.withColumns(request_columns(F.col("task_id"), profile, seed))
