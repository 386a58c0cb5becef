import pandas as pd
from pyspark.sql import functions as F

from berthline.plans.catalog import load_share
from berthline.plans.placement import PlacementRules, place_snapshot
from berthline.session import scratch_path
from berthline.streaming import jobs as st
from tests.helpers import fleet, ledger, machine, random_ledger, task, workload


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    # the watermark of one batch judges the rows of the batch after the next
    rows = [
        [("2024-01-01 00:10:00", 0.2), ("2024-01-01 03:00:00", 0.4)],
        [("2024-01-01 05:00:00", 0.1)],
        [("2024-01-01 00:20:00", 0.9), ("2024-01-01 05:30:00", 0.1)],
    ]
    for part in rows:
        spark.createDataFrame([(1, t, u) for t, u in part], "machine_id long, t string, cpu_util double").select(
            "machine_id", F.to_timestamp("t").alias("ts"), "cpu_util").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("machine_id long, ts timestamp, cpu_util double").option("maxFilesPerTrigger", 1).parquet(str(source))
    windows = st.utilization_windows(stream)
    out = scratch_path(spark, "late")
    st.start(windows, st.append_to(out), scratch_path(spark, "late-state")).awaitTermination()
    got = {str(r.window_start): r.n for r in st.read_appended(spark, out, windows.schema).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 03:00:00": 1}


def test_releases_follow_the_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    source = tmp_path / "in"
    day = 86_400_000
    batches = [[(1, 10, 1, 2 * day), (1, 11, 1, 3 * day), (2, 12, day, day + 5)], [(1, 13, 2 * day, 9 * day)], [(2, 14, 4 * day, 5 * day)]]
    for part in batches:
        spark.createDataFrame(part, "machine_id long, task_id long, s long, finish_ms long").select(
            "machine_id", "task_id", F.timestamp_millis("s").alias("start"), "finish_ms"
        ).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("machine_id long, task_id long, start timestamp, finish_ms long").option(
        "maxFilesPerTrigger", 1).parquet(str(source))
    out = scratch_path(spark, "release")
    st.start(st.occupancy_state(stream, shards=2), st.append_to(out), scratch_path(spark, "release-state")).awaitTermination()
    got = {(r.task_id, r.released_ms) for r in st.read_appended(spark, out, st.RELEASE_SCHEMA).collect()}
    assert got == {(10, 2 * day), (11, 3 * day), (12, day + 5)}


class CountingState:
    """Map state and timers in memory that count reads."""

    def __init__(self):
        self.rows, self.reads, self.timers = {}, 0, set()

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        self.reads += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.due


def test_a_timer_reads_its_own_bucket_only():
    state, day = CountingState(), 86_400_000
    processor = st.ReleaseProcessor(day)
    processor.init(state)
    state.now = 0
    finishes = [d * day + 1000 * i for d in range(1, 101) for i in range(50)]
    batch = pd.DataFrame({"finish_ms": finishes, "task_id": range(len(finishes))})
    assert list(processor.handleInputRows((1, 0), iter([batch]), state)) == []
    assert state.timers == {d * day for d in range(1, 101)} and state.reads == 0
    state.now = state.due = 3 * day + 10_000
    state.due = 3 * day
    released = pd.concat(processor.handleExpiredTimer((1, 0), state, state))
    assert released["released_ms"].tolist() == [3 * day + 1000 * i for i in range(11)]
    assert state.reads == 1 and len(state.rows[(3,)][0]) == 39 and 3 * day + 11_000 in state.timers
    state.now = state.due = 4 * day - 1
    state.due = 3 * day + 11_000
    assert len(pd.concat(processor.handleExpiredTimer((1, 0), state, state))) == 39
    assert (3,) not in state.rows and state.reads == 2
    assert list(processor.handleExpiredTimer((1, 0), state, state)) == []


def test_a_group_holds_many_machines_in_one_entry_per_bucket():
    state, day = CountingState(), 86_400_000
    processor = st.ReleaseProcessor(day)
    processor.init(state)
    state.now = 0
    rows = pd.DataFrame({"finish_ms": [d * day + m for d in range(1, 4) for m in range(200)], "task_id": range(600),
                         "machine_id": [m for _ in range(3) for m in range(200)]})
    assert list(processor.handleInputRows((5,), iter([rows[:350], rows[350:]]), state)) == []
    assert len(state.rows) == 3 and state.timers == {d * day for d in range(1, 4)} and state.reads == 0
    state.now, state.due = day + 149, day
    gone = pd.concat(processor.handleExpiredTimer((5,), state, state))
    assert gone["machine_id"].tolist() == list(range(150)) == gone["task_id"].tolist()
    assert state.rows[(1,)][2] == list(range(150, 200)) and day + 150 in state.timers


def test_state_groups_do_not_grow_with_the_machines(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    source, day = tmp_path / "in", 86_400_000
    batches = [[(m, m, 1, 2 * day + m) for m in range(300)], [(1, 1000, 9 * day, 10 * day)]]
    for part in batches:
        spark.createDataFrame(part, "machine_id long, task_id long, s long, finish_ms long").select(
            "machine_id", "task_id", F.timestamp_millis("s").alias("start"), "finish_ms"
        ).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("machine_id long, task_id long, start timestamp, finish_ms long").option(
        "maxFilesPerTrigger", 1).parquet(str(source))
    out = scratch_path(spark, "release")
    run = st.start(st.occupancy_state(stream, shards=4), st.append_to(out), scratch_path(spark, "release-state"))
    run.awaitTermination()
    # an entry and two of its timer for each shard and bucket
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 3 * 4 * 2
    got = {(r.machine_id, r.task_id, r.released_ms) for r in st.read_appended(spark, out, st.RELEASE_SCHEMA).collect()}
    assert got == {(m, m, 2 * day + m) for m in range(300)}


def test_a_stored_ledger_is_pruned_to_the_batch(spark, tmp_path):
    day = 86_400_000
    rows = ledger(spark, [(i, i % 7, i * day, i * day + 3 * day // 2, 1.0, 0.0, 0.0, 1.0) for i in range(60)])
    path = st.write_ledger(rows, str(tmp_path / "ledger"))
    active = st.read_active(spark, path, 50 * day, 50 * day + 5)
    assert sorted(r.task_id for r in active.collect()) == [49, 50]
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(finish_part" in plan and "finish_part#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_windows_of_all_resources(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 0.2, 0.5, 0.1), (1, "2024-01-01 00:20:00", 0.4, 0.7, 0.3)],
                                 "machine_id long, t string, cpu_util double, gpu_util double, ram_util double")
    got = st.utilization_windows(rows.withColumn("ts", F.to_timestamp("t"))).first()
    assert (got.n, round(got.avg_cpu, 9), got.max_gpu, round(got.avg_ram, 9)) == (2, 0.3, 0.7, 0.2)


def test_batches_of_tasks_are_placed_like_all_at_once(spark, tmp_path):
    """Several files, one a batch, of which the last repeats nothing and lies far from the others."""
    pool = [machine(i, i % 5) for i in range(8)]
    rows = ledger(spark, random_ledger(6, 80, 8, 200))
    tasks = [task(i, cpu=1 + i % 9, ram=1 + i % 30, arrival_ms=(i % 3) * 70_000 + i // 3 * 5000) for i in range(30)]
    source = tmp_path / "in"
    for third in range(3):
        workload(spark, [t for t in tasks if t[0] % 3 == third]).coalesce(1).write.mode("append").parquet(str(source))
    everything = spark.read.parquet(str(source))
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out, machines = scratch_path(spark, "placed"), fleet(spark, pool)
    st.place_stream(stream, machines, lambda: rows, load_share, PlacementRules(), out, scratch_path(spark, "placed-state")).awaitTermination()
    want = place_snapshot(everything, machines, rows, load_share, PlacementRules())
    got = st.read_appended(spark, out, want.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    stored, ranged = st.write_ledger(rows, scratch_path(spark, "ledger"), 60_000), scratch_path(spark, "placed")
    st.place_stream(stream, machines, lambda a, b: st.read_active(spark, stored, a, b, 60_000), load_share, PlacementRules(),
                    ranged, scratch_path(spark, "placed-state"), ranged=True).awaitTermination()
    assert sorted(map(repr, st.read_appended(spark, ranged, want.schema).collect())) == sorted(map(repr, want.collect()))


def test_newest_row_of_each_key(spark, tmp_path):
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("b", 5), ("c", 3)]]):
        spark.createDataFrame(rows, "k string, n int").write.parquet(f"{tmp_path}/batch_id={batch}")
    schema = spark.createDataFrame([], "k string, n int").schema
    got = {r.k: r.n for r in st.read_newest(spark, str(tmp_path), schema, ["k"]).collect()}
    assert got == {"a": 2, "b": 5, "c": 3}
