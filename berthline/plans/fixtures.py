"""Machines, tasks, allocations and scored rows derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berthline.functions.numeric import epoch_ms
from berthline.operators.candidates import assemble_features, with_remaining
from berthline.operators.ledger import with_current_power
from berthline.operators.skew import salted_join
from berthline.schemas import FEATURE_COLUMNS, REMAINING, REQUEST_COLUMNS, REQUESTS, RESOURCES, presets

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One machine per supplier, its preset by key; usage from the key as well."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("machine_id"), F.col("s_name").alias("machine_name"),
        (F.col("s_suppkey") % 5).alias("preset_idx"),
    )
    spec = s.join(F.broadcast(presets(spark)), "preset_idx").drop("preset_idx", "preset")
    k = F.col("machine_id")
    used = spec.withColumns(
        {
            "cpu_cores_used": (k % 4).cast("double"),
            "gpu_cores_used": F.when(F.col("gpu_cores_total") > 0, (k % 5) * 128).otherwise(0).cast("double"),
            "gpu_vram_used_gb": F.when(F.col("gpu_vram_total_gb") > 0, k % 3).otherwise(0).cast("double"),
            "ram_used_gb": (k % 7).cast("double"),
        }
    )
    return with_current_power(used)


def request_values(key: str) -> dict:
    k = F.col(key)
    gpu = k % 3 == 0
    return {
        "req_cpu_cores": (1 + k % 8).cast("double"),
        "req_gpu_cores": F.when(gpu, (k * 37) % 513).otherwise(0).cast("double"),
        "req_gpu_vram_gb": F.when(gpu, k % 16).otherwise(0).cast("double"),
        "req_ram_gb": (2 + (k * 5) % 15).cast("double"),
    }


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per order."""
    return tasks_of(table(spark, sf_dir, "orders"))


def tasks_of(orders: DataFrame) -> DataFrame:
    o = orders.select(
        F.col("o_orderkey").alias("task_id"), epoch_ms("o_orderdate").alias("arrival_ms")
    )
    seconds = F.lit(5.0) + ((F.col("task_id") * 13) % 5501).cast("double") / F.lit(100.0)
    return o.withColumns(request_values("task_id")).withColumn("execution_time", seconds)


def fractional_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per order whose requests are fractions of its price and hardly repeat."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), epoch_ms("o_orderdate").alias("arrival_ms"),
        F.expr("CAST(o_totalprice AS DOUBLE) / 1000.0D - floor(CAST(o_totalprice AS DOUBLE) / 1000.0D)").alias("_u"),
        F.expr("CAST(o_totalprice AS DOUBLE) / 7.0D - floor(CAST(o_totalprice AS DOUBLE) / 7.0D)").alias("_v"),
    )
    gpu = F.col("task_id") % 3 == 0
    return o.withColumns({
        "req_cpu_cores": F.expr("0.25D + 7.0D * _u"), "req_gpu_cores": F.when(gpu, F.expr("500.0D * _v")).otherwise(0.0),
        "req_gpu_vram_gb": F.when(gpu, F.expr("15.0D * _u")).otherwise(0.0), "req_ram_gb": F.expr("0.5D + 20.0D * _v"),
    }).drop("_u", "_v")


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One allocation per line item: quantity hours from the ship date."""
    return allocations_of(table(spark, sf_dir, "lineitem"))


def allocations_of(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("machine_id"),
        epoch_ms("l_shipdate").alias("start_ms"), "l_quantity",
    )
    finish = F.col("start_ms") + (F.col("l_quantity") * F.lit(HOUR_MS)).cast("bigint")
    return li.withColumn("finish_ms", finish).drop("l_quantity").withColumns(request_values("task_id"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and probabilities per order, with ties on purpose."""
    return scored_of(table(spark, sf_dir, "orders"))


def scored_of(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_orderpriority")
    y = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    p = ((F.col("o_orderkey") * 7919) % 1000).cast("double") / F.lit(1000.0) * F.lit(0.5) + F.lit(0.4) * F.col(
        "y"
    ) + F.lit(0.05)
    return (
        o.withColumn("y", y)
        .withColumn("p", p)
        .select(
            F.col("o_orderkey").alias("row_id"), "y", "p",
            F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("model_used"),
        )
    )


def raw_tasks(spark: SparkSession, sf_dir: str, with_time: bool = True) -> DataFrame:
    """Orders as an unclean text workload."""
    t = tasks(spark, sf_dir)
    k = F.col("task_id")
    cpu = F.when(k % 7 == 0, F.lit("n/a")).otherwise(
        F.when(k % 11 == 0, -F.col("req_cpu_cores")).otherwise(F.col("req_cpu_cores")).cast("string")
    )
    columns = {c: F.col(c).cast("string") for c in REQUEST_COLUMNS + ["execution_time"]}
    columns["req_cpu_cores"] = cpu
    columns["req_ram_gb"] = F.when(k % 13 != 0, F.col("req_ram_gb").cast("string"))
    raw = t.select("task_id", *[v.alias(c) for c, v in columns.items()])
    return raw if with_time else raw.drop("execution_time")


def with_status(scored_rows: DataFrame) -> DataFrame:
    k = F.col("row_id")
    status = (
        F.when(k % 10 == 0, F.lit("no_free_machine"))
        .when(k % 10 == 1, F.lit("no_suitable_free_machine"))
        .when(F.col("p") >= F.lit(0.8), F.lit("all_predict_violation"))
        .otherwise(F.lit("scheduled"))
    )
    return scored_rows.withColumn("status", status)


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement results derived from the scored rows, for the reports."""
    s = with_status(scored(spark, sf_dir))
    k = F.col("row_id")
    machine_count = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    done = F.col("status") == "scheduled"
    return (
        s
        .select(
            k.alias("task_id"),
            "status",
            F.when(done, (k * 31) % machine_count).alias("machine_id"),
            F.when(done, F.col("p")).alias("sla_probability"),
            F.when(done, ((k * 17) % 101).cast("double") / F.lit(100.0)).alias("energy_score"),
            F.when(done, ((k * 29) % 97).cast("double") / F.lit(96.0)).alias("fit_score"),
            "model_used",
        )
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled model inputs: every task meets the machine ``task_id mod fleet size``.

    The label is 1 when any request exceeds 0.8 of what remains, or asks for a resource
    of which nothing remains.
    """
    fleet = with_remaining(machines(spark, sf_dir)).drop("machine_name", "cost_per_hour")
    size = fleet.agg(F.count(F.lit(1))).scalar()
    t = tasks(spark, sf_dir).withColumn("machine_id", F.col("task_id") % size)
    pairs = assemble_features(salted_join(t, fleet, ["machine_id"], ["task_id"]))
    tight = F.lit(False)
    for r in RESOURCES:
        ask, left = F.col(REQUESTS[r]), F.col(REMAINING[r])
        tight = tight | ((left <= 0) & (ask > 0)) | ((left > 0) & (ask > F.lit(0.8) * left))
    return pairs.withColumn("sla_violation", tight.cast("int")).select(
        F.col("task_id").alias("row_id"), *FEATURE_COLUMNS, "sla_violation"
    )


def utilization_events(events: DataFrame) -> DataFrame:
    """Event rows read as utilisation samples of machine ``user_id``."""
    return events.select(
        F.col("user_id").alias("machine_id"),
        F.timestamp_millis(epoch_ms("ts")).alias("ts"),
        ((F.col("event_id") % 101).cast("double") / F.lit(100.0)).alias("cpu_util"),
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
