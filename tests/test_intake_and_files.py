import pytest
from pyspark.sql import functions as F

from berthline.operators import intake, pool
from berthline.schemas import FEATURE_COLUMNS, TASK_COLUMNS
from berthline.sources import files, workload
from tests.helpers import fleet, machine


def test_three_of_five_columns_are_rejected_and_four_accepted():
    with pytest.raises(ValueError, match="req_ram_gb"):
        intake.admit_schema(["req_cpu_cores", "req_gpu_cores", "execution_time"])
    present, absent = intake.admit_schema(["execution_time", "req_cpu_cores", "req_gpu_cores", "req_ram_gb", "x"])
    assert absent == ["req_gpu_vram_gb"] and len(present) == 4
    assert intake.admission_report(TASK_COLUMNS)["missing"] == ""


def test_dirty_values(spark):
    raw = spark.createDataFrame(
        [("NaN", "inf", " 12 ", "1,000"), ("-3", None, "", "n/a")],
        "req_cpu_cores string, req_gpu_cores string, req_gpu_vram_gb string, req_ram_gb string",
    )
    rows = [tuple(r) for r in intake.clean_tasks(raw).collect()]
    assert rows == [(0.0, float("inf"), 12.0, 0.0, 30.0), (3.0, 0.0, 0.0, 0.0, 30.0)]


def test_csv_round_trip_and_summary(spark, tmp_path):
    path = tmp_path / "tasks.csv"
    path.write_text("req_cpu_cores,req_gpu_cores,req_ram_gb,execution_time,note\n2,0,4,bad,a\n-4,1,8,5,b\n")
    tasks = intake.clean_tasks(files.read_tasks(spark, str(path)))
    assert sorted(tuple(r) for r in tasks.collect()) == [(2.0, 0.0, 0.0, 4.0, 0.0), (4.0, 1.0, 0.0, 8.0, 5.0)]
    assert tuple(intake.workload_summary(tasks).first()) == (2, 3.0, 6.0)


def test_workload_profiles_stay_in_range(spark):
    for profile, ranges in workload.PROFILES.items():
        w = workload.generate_workload(spark, 2000, profile)
        low = w.agg(*[F.min(c).alias(c) for c in TASK_COLUMNS]).first()
        high = w.agg(*[F.max(c).alias(c) for c in TASK_COLUMNS]).first()
        assert (low.req_cpu_cores, high.req_cpu_cores) == ranges["cpu"]
        assert (low.req_ram_gb, high.req_ram_gb) == ranges["ram"]
        assert high.req_gpu_cores <= ranges["gpu"][1] and 5 <= low.execution_time and high.execution_time <= 60
        assert high.req_gpu_vram_gb == (15 if ranges["gpu"][1] else 0)
    a, b = workload.generate_workload(spark, 50), workload.generate_workload(spark, 50).repartition(3)
    assert sorted(a.collect()) == sorted(b.collect())
    with pytest.raises(ValueError):
        workload.request_columns(F.col("id"), "Huge")


def test_pool_from_presets_numbers_across_the_pool(spark):
    wanted = spark.createDataFrame([(1, "Beast", 2), (2, "Small VM", 1), (3, "Beast", 0)], "request_id long, preset string, count int")
    names = [r.machine_name for r in pool.build_pool(wanted, per_bucket=1).orderBy("machine_id").collect()]
    assert names == ["Beast-1", "Beast-2", "Small VM-3"]


def test_custom_specs_split_with_reasons(spark):
    specs = fleet(spark, [machine(1), machine(2, cpu_cores_total=129.0, cost_per_hour=0.05)]).withColumn(
        "machine_name", F.lit(None).cast("string"))
    valid, rejected = pool.split_valid(specs)
    assert valid.first().machine_name == "Custom-1"
    assert rejected.first().reasons == ["cpu_cores_total outside 1..128", "cost_per_hour outside 0.1..10.0"]


def test_labels_pair_by_file_order_and_compliant_rows_are_written(spark, tmp_path):
    head = ",".join(FEATURE_COLUMNS)
    (tmp_path / "x.csv").write_text(head + "\n" + "\n".join(",".join([str(i)] * 16) for i in range(6)) + "\n")
    (tmp_path / "y.csv").write_text("sla_violation\n0\n1\n0\n1\n1\n0\n")
    x, y = files.read_features(spark, str(tmp_path / "x.csv")), files.read_labels(spark, str(tmp_path / "y.csv"))
    kept = files.compliant_tasks(x, y, str(tmp_path / "out"))
    assert sorted(r.cpu_cores_total for r in kept.collect()) == [0.0, 2.0, 5.0]
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_model_meta_defaults_and_round_trip(spark, tmp_path):
    (tmp_path / "meta.json").write_text('{\n "feature_cols": ["a"],\n "threshold": 0.59\n}')
    meta = files.read_model_meta(spark, str(tmp_path / "meta.json"))
    row = meta.first()
    assert (row.feature_cols, row.threshold, row.temperature) == (["a"], 0.59, 1.0)
    files.write_model_meta(meta, str(tmp_path / "copy"))
    assert files.read_model_meta(spark, str(tmp_path / "copy")).first() == row


def test_stamped_exports(spark, tmp_path):
    df = fleet(spark, [machine(1), machine(2)])
    for write in (files.write_results, files.write_machines, files.write_utilization):
        assert spark.read.option("header", True).csv(write(df, str(tmp_path))).count() == 2
    assert spark.read.parquet(files.write_results(df, str(tmp_path / "p"), "parquet")).count() == 2
    with pytest.raises(ValueError):
        files.write_results(df, str(tmp_path), "xlsx")


def test_rows_are_numbered_across_many_files_and_blocks(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2).cast("int").alias("sla_violation"), F.col("id"))
    rows.orderBy("id").select("sla_violation").write.option("header", True).csv(str(tmp_path / "labels"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        numbered = files.number_rows(files.read_labels(spark, str(tmp_path / "labels")))
        got = numbered.select("row_id", "sla_violation").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.row_id for r in got) == list(range(5000))
    assert all(r.sla_violation == r.row_id % 2 for r in got)


def test_one_large_request_is_listed_by_many_tasks(spark):
    asked = spark.createDataFrame([(1, "Beast", 3), (2, "Small VM", 10_000_000), (3, "GPU Node", 2)], "request_id long, preset string, count long")
    built = pool.build_pool(asked).withColumn("_part", F.spark_partition_id())
    got = built.agg(F.count(F.lit(1)).alias("n"), F.min("machine_id").alias("lo"), F.max("machine_id").alias("hi"),
                    F.sum("machine_id").alias("s"), F.count_distinct("_part").alias("parts")).first()
    n = 10_000_005
    assert (got.n, got.lo, got.hi, got.s) == (n, 1, n, n * (n + 1) // 2)
    assert got.parts > 1
    assert [r.machine_name for r in built.filter(F.col("machine_id").isin(3, 4, n)).orderBy("machine_id").collect()] == [
        "Beast-3", "Small VM-4", f"GPU Node-{n}"]
