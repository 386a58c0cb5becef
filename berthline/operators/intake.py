"""Workload intake: admission, defaults, cleaning and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.functions.numeric import clean_number
from berthline.schemas import DEFAULT_EXECUTION_TIME, REQUEST_COLUMNS, TASK_COLUMNS

MIN_TASK_COLUMNS = 4


def admit_schema(columns: list[str]) -> tuple[list[str], list[str]]:
    """(present, absent) task columns; fewer than four present is an error."""
    present = [c for c in TASK_COLUMNS if c in columns]
    absent = [c for c in TASK_COLUMNS if c not in columns]
    if len(present) < MIN_TASK_COLUMNS:
        raise ValueError(
            f"invalid workload: expected columns {', '.join(REQUEST_COLUMNS)}; found {', '.join(present) or 'none'}"
        )
    return present, absent


def admission_report(columns: list[str]) -> dict[str, str]:
    present, absent = admit_schema(columns)
    return {"used": ", ".join(present), "missing": ", ".join(absent)}


def fill_missing_columns(df: DataFrame) -> DataFrame:
    """Add absent task columns: 30 seconds of execution time, 0 of anything else."""
    defaults = {c: DEFAULT_EXECUTION_TIME if c == "execution_time" else 0.0 for c in TASK_COLUMNS}
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def clean_tasks(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Admit, complete and clean a workload: recognised columns as non-negative doubles."""
    admit_schema(raw.columns)
    full = fill_missing_columns(raw)
    return full.select(*keep, *[clean_number(c).alias(c) for c in TASK_COLUMNS])


def workload_summary(tasks: DataFrame) -> DataFrame:
    """Task count, mean CPU and mean RAM request."""
    return tasks.agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.avg("req_cpu_cores").alias("avg_cpu"),
        F.avg("req_ram_gb").alias("avg_ram"),
    )


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)
