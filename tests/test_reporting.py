from berthline.operators import ledger as ld
from berthline.plans import fixtures as fx
from berthline.plans.reporting import ledger_report, run_report

SF = "/root/testdata/sf0.001"


def test_ledger_report_frames_agree(spark):
    allocations, machines = fx.allocations(spark, SF), fx.machines(spark, SF)
    report = ledger_report(allocations, machines)
    assert report["machine_ledger"].agg({"n_tasks": "sum"}).first()[0] == allocations.count()
    assert report["utilization_long"].count() == 3 * report["utilization_timeline"].count()
    assert report["latest_sample"].filter("active_tasks <> 0").isEmpty()


def test_run_report_frames_agree(spark):
    placements = fx.placements(spark, SF)
    report = run_report(placements, ld.machine_ledger(fx.allocations(spark, SF), fx.machines(spark, SF)))
    kpis = report["run_kpis"].first()
    assert kpis.n_scheduled + kpis.n_failed == kpis.n_tasks == 1500
    assert report["task_distribution"].agg({"n_tasks": "sum"}).first()[0] == kpis.n_scheduled
    assert report["sla_histogram"].agg({"n": "sum"}).first()[0] == kpis.n_scheduled
    assert report["energy_fit_density"].agg({"n": "sum"}).first()[0] == kpis.n_scheduled
    assert [r.task_id for r in report["recent_log"].collect()] == list(range(1490, 1500))


def test_scheduled_tasks_become_ledger_rows(spark):
    placed = spark.createDataFrame(
        [(1, 7, 1000, 2.5, 1.0, 0.0, 0.0, 1.0), (2, None, 1000, 2.5, 1.0, 0.0, 0.0, 1.0), (3, 7, 0, None, 1.0, 0.0, 0.0, 1.0)],
        "task_id long, machine_id long, arrival_ms long, execution_time double, req_cpu_cores double,"
        " req_gpu_cores double, req_gpu_vram_gb double, req_ram_gb double",
    )
    rows = {r.task_id: (r.start_ms, r.finish_ms) for r in ld.record_allocations(placed).collect()}
    assert rows == {1: (1000, 3500), 3: (0, 1000)}


def test_used_from_free(spark):
    row = ld.used_from_free(spark.createDataFrame([(8.0, 3.0)], "cpu_cores_total double, cpu_free double"),
                            {"cpu": "cpu_free"}).first()
    assert row.cpu_cores_used == 5.0


def test_the_frames_of_a_ledger_share_one_timeline(spark):
    allocations, machines = fx.allocations(spark, SF), fx.machines(spark, SF)
    report = ledger_report(allocations, machines)
    for name in ("utilization_timeline", "utilization_long", "latest_sample"):
        plan = report[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "timeline-" in " ".join(report[name].inputFiles())
