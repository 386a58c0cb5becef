"""File sources and sinks: workloads, features, labels, metadata and results."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthline.operators.ledger import flatten_history
from berthline.schemas import FEATURE_SCHEMA, MODEL_META_SCHEMA, TASK_SCHEMA

DEFAULT_THRESHOLD = 0.5
DEFAULT_TEMPERATURE = 1.0


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Workload CSV with a header, every column as text; cleaning decides what is a number."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV with the 16 declared columns."""
    return spark.read.schema(FEATURE_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One-column label CSV."""
    raw = spark.read.schema(T.StructType([T.StructField("sla_violation", T.StringType())]))
    text = raw.option("header", True).csv(path)
    return text.select(F.col("sla_violation").try_cast("double").cast("int").alias("sla_violation"))


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    """Feature list, threshold, recall target and temperature of a model, with defaults."""
    meta = spark.read.schema(MODEL_META_SCHEMA).option("multiLine", True).json(path)
    return meta.withColumns(
        {
            "feature_cols": F.coalesce("feature_cols", F.array().cast("array<string>")),
            "threshold": F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)),
            "temperature": F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)),
        }
    )


def number_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row numbers in file order, for sources that offer nothing else to join on.

    The order is that of the file names, then of the places in a file. ``df`` comes from a file
    reader. Rows are numbered within their block of a file and shifted by the sizes of the blocks
    before it; only those sizes are ordered as a whole.
    """
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    marked = df.select("*", *at, F.monotonically_increasing_id().alias("_seq"))
    # a block is read by one task, row after row, whatever other blocks that task reads
    blocks = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = W.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    shifts = blocks.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), shift.alias("_shift"))
    numbered = marked.join(shifts, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return numbered.select((F.col("_seq") + F.col("_shift")).alias(name), *df.columns)


def attach_labels(features: DataFrame, labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Labels joined to features on an explicit row id, numbered in file order if absent.

    Files of different length are an error: a row that has no partner fails the job.
    """
    left = features if row_id in features.columns else number_rows(features, row_id)
    right = labels if row_id in labels.columns else number_rows(labels, row_id)
    sides = left.withColumn("_left", F.lit(True)).join(
        right.select(row_id, "sla_violation", F.lit(True).alias("_right")), row_id, "full"
    )
    lonely = F.raise_error(F.lit("features and labels do not have the same rows")).cast("boolean")
    return sides.filter(F.coalesce(F.col("_left") & F.col("_right"), lonely)).drop("_left", "_right")


def compliant_tasks(features: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """Feature rows whose label is 0, optionally written as CSV."""
    kept = attach_labels(features, labels).filter(F.col("sla_violation") == 0)
    if path:
        write_csv(kept.drop("row_id"), path)
    return kept


def stamped(prefix: str, spark: SparkSession) -> str:
    """``prefix_yyyyMMdd_HHmmss``."""
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    return f"{prefix}_{datetime.now(zone):%Y%m%d_%H%M%S}"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_results(placements: DataFrame, directory: str, format: str = "csv") -> str:
    """Placement results under a time-stamped name, as CSV or Parquet."""
    return _write(placements, directory, "placement_results", format)


def write_machines(snapshot: DataFrame, directory: str, format: str = "csv") -> str:
    """The machine snapshot under a time-stamped name."""
    return _write(snapshot, directory, "machine_data", format)


def write_utilization(samples: DataFrame, directory: str, format: str = "csv") -> str:
    """Utilisation samples, flattened first when they come as a nested history."""
    flat = flatten_history(samples) if "history" in samples.columns else samples
    return _write(flat, directory, "utilization_history", format)


def _write(df: DataFrame, directory: str, prefix: str, format: str) -> str:
    path = f"{directory.rstrip('/')}/{stamped(prefix, df.sparkSession)}"
    if format == "csv":
        return write_csv(df, path)
    if format != "parquet":
        raise ValueError("format must be csv or parquet")
    df.write.parquet(path)
    return path


def write_model_meta(meta: DataFrame, path: str) -> str:
    """Model metadata as JSON."""
    meta.select(*MODEL_META_SCHEMA.fieldNames()).write.mode("overwrite").json(path)
    return path


def write_metrics(metrics: DataFrame, path: str) -> str:
    """Metrics as JSON, one line per row."""
    metrics.write.mode("overwrite").json(path)
    return path


def stream_tasks(spark: SparkSession, path: str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Task files of a folder as a stream."""
    reader = spark.readStream.schema(TASK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("header", True).csv(path) if format == "csv" else reader.parquet(path)
