"""Declared schemas, column lists and fixed lookup values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Resource names, feature order, presets, status names, limits and defaults.
RESOURCES = ("cpu", "gpu", "vram", "ram")
TOTALS = {"cpu": "cpu_cores_total", "gpu": "gpu_cores_total", "vram": "gpu_vram_total_gb", "ram": "ram_total_gb"}
USED = {"cpu": "cpu_cores_used", "gpu": "gpu_cores_used", "vram": "gpu_vram_used_gb", "ram": "ram_used_gb"}
REQUESTS = {"cpu": "req_cpu_cores", "gpu": "req_gpu_cores", "vram": "req_gpu_vram_gb", "ram": "req_ram_gb"}
REMAINING = {
    "cpu": "remaining_cpu_cores",
    "gpu": "remaining_gpu_cores",
    "vram": "remaining_gpu_vram_gb",
    "ram": "remaining_ram_gb",
}

REQUEST_COLUMNS = list(REQUESTS.values())
TASK_COLUMNS = REQUEST_COLUMNS + ["execution_time"]
MACHINE_COLUMNS = [
    "cpu_cores_total", "cpu_watts", "gpu_cores_total", "gpu_vram_total_gb", "gpu_watts", "ram_total_gb",
    "cpu_cores_used", "gpu_cores_used", "gpu_vram_used_gb", "ram_used_gb",
    "current_cpu_power_w", "current_gpu_power_w",
]
FEATURE_COLUMNS = MACHINE_COLUMNS + REQUEST_COLUMNS
SPEC_COLUMNS = [
    "cpu_cores_total", "gpu_cores_total", "gpu_vram_total_gb", "ram_total_gb",
    "cpu_watts", "gpu_watts", "cost_per_hour",
]

DEFAULT_EXECUTION_TIME = 30.0
DEFAULT_CPU_POWER_W = 50.0
DEFAULT_GPU_POWER_W = 100.0

PRESETS = [
    (0, "Small VM", 4.0, 0.0, 0.0, 8.0, 65.0, 0.0, 0.50),
    (1, "GPU Node", 8.0, 2048.0, 16.0, 32.0, 95.0, 250.0, 2.80),
    (2, "Balanced", 16.0, 1024.0, 8.0, 64.0, 120.0, 150.0, 1.60),
    (3, "High RAM", 8.0, 0.0, 0.0, 128.0, 85.0, 0.0, 1.20),
    (4, "Beast", 32.0, 4096.0, 48.0, 256.0, 200.0, 400.0, 5.50),
]

SPEC_RANGES = {
    "cpu_cores_total": (1, 128),
    "gpu_cores_total": (0, 8192),
    "gpu_vram_total_gb": (0, 128),
    "ram_total_gb": (1, 512),
    "cpu_watts": (1, 400),
    "gpu_watts": (0, 600),
    "cost_per_hour": (0.1, 10.0),
}

SCHEDULED = "scheduled"
NO_ARRIVAL = "no_arrival_time"
NO_FREE = "no_free_machine"
NO_SUITABLE = "no_suitable_free_machine"
ALL_VIOLATE = "all_predict_violation"
FAILED = "optimization_failed"
SCORE_ERROR = "score_error"


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


RAW_TASK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TASK_COLUMNS])
TASK_SCHEMA = T.StructType(
    [T.StructField("task_id", T.LongType()), T.StructField("arrival_ms", T.LongType())] + _doubles(TASK_COLUMNS)
)
FEATURE_SCHEMA = T.StructType(_doubles(FEATURE_COLUMNS))
LABEL_SCHEMA = T.StructType([T.StructField("sla_violation", T.IntegerType())])
SPEC_SCHEMA = T.StructType(
    [T.StructField("machine_id", T.LongType()), T.StructField("machine_name", T.StringType())]
    + _doubles(SPEC_COLUMNS)
)
PRESET_SCHEMA = T.StructType(
    [T.StructField("preset_idx", T.LongType()), T.StructField("preset", T.StringType())] + _doubles(SPEC_COLUMNS)
)
ALLOCATION_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("machine_id", T.LongType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("finish_ms", T.LongType()),
    ]
    + _doubles(REQUEST_COLUMNS)
)
SAMPLE_TYPE = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("cpu_util", T.DoubleType()),
        T.StructField("gpu_util", T.DoubleType()),
        T.StructField("ram_util", T.DoubleType()),
        T.StructField("active_tasks", T.LongType()),
    ]
)
UTILIZATION_SCHEMA = T.StructType([T.StructField("machine_id", T.LongType())] + SAMPLE_TYPE.fields)
PLACEMENT_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("machine_id", T.LongType()),
        T.StructField("sla_probability", T.DoubleType()),
        T.StructField("energy_score", T.DoubleType()),
        T.StructField("fit_score", T.DoubleType()),
        T.StructField("model_used", T.StringType()),
    ]
)
MODEL_META_SCHEMA = T.StructType(
    [
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("recall_target", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
    ]
)


def presets(spark: SparkSession) -> DataFrame:
    """The five preset machine types: an inline table, so the optimizer knows its size."""
    rows = ", ".join(
        f"({idx}L, '{name}', " + ", ".join(f"{v!r}D" for v in values) + ")" for idx, name, *values in PRESETS
    )
    names = ", ".join(PRESET_SCHEMA.fieldNames())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS presets({names})")


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    """Raise with the list of absent columns, else hand the frame back."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks columns: {', '.join(absent)}")
    return df
