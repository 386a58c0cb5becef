import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from berthline.operators import ledger as ld
from berthline.operators import occupancy as oc
from tests.helpers import fleet, ledger, machine, random_ledger

ROWS = random_ledger(11, 400, 6, 300)
TIMES = list(range(0, 330_000, 7000))


@pytest.fixture(scope="module")
def world(spark):
    return ledger(spark, ROWS).cache(), fleet(spark, [machine(i, 4) for i in range(8)]).cache()


def active(t, m, strict=False):
    return [r for r in ROWS if r[1] == m and (r[2] < t if strict else r[2] <= t) and t < r[3]]


@pytest.mark.parametrize("strict", [False, True])
def test_usage_at_points(spark, world, strict):
    points = spark.createDataFrame([(m, t) for m in range(8) for t in TIMES], "machine_id long, time_ms long")
    out = oc.usage_at(points, world[0], strict_start=strict, bucket_ms=20_000).collect()
    assert len(out) == 8 * len(TIMES)
    for r in out:
        held = active(r.time_ms, r.machine_id, strict)
        assert (r.active_tasks, r.cpu_cores_used, r.ram_used_gb) == (
            len(held), sum(x[4] for x in held), sum(x[7] for x in held))


def test_a_machine_is_free_at_the_instant_its_task_ends(spark):
    one = ledger(spark, [(1, 1, 1000, 5000, 1.0, 0.0, 0.0, 1.0)])
    at = spark.createDataFrame([(1, 999), (1, 1000), (1, 4999), (1, 5000)], "machine_id long, time_ms long")
    assert {r.time_ms for r in oc.free_pairs(at, one).collect()} == {999, 5000}
    assert {r.time_ms for r in oc.busy_pairs(at, one).collect()} == {1000, 4999}


@pytest.mark.parametrize("bits", [10, 32])
def test_free_machines_per_instant_and_class(spark, world, bits):
    instants = spark.createDataFrame([(t,) for t in TIMES], "time_ms long")
    spans = oc.idle_spans(world[0], world[1], 20_000).withColumn("odd", F.col("machine_id") % 2)
    got = {(r.time_ms, r.odd): (r.n_free, r.first_free_id)
           for r in oc.free_by_class(instants, spans, ["odd"], 1000, bits).collect()}
    listed = {}
    for r in oc.free_members(instants, spans, ["odd"], 1000, bits).collect():
        listed.setdefault((r.time_ms, r.odd), []).append(r.machine_id)
    for t in TIMES:
        for odd in (0, 1):
            free = [m for m in range(8) if m % 2 == odd and not active(t, m)]
            assert got.get((t, odd)) == ((len(free), min(free)) if free else None)
            assert sorted(listed.get((t, odd), [])) == free


def test_busy_counts(spark, world):
    instants = spark.createDataFrame([(t,) for t in TIMES], "time_ms long")
    for r in oc.busy_counts(instants, world[0], world[1]).collect():
        assert r.n_busy == sum(bool(active(r.time_ms, m)) for m in range(8))


def test_instants_off_the_clock_grid_are_an_error(spark, world):
    instants = spark.createDataFrame([(1500,)], "time_ms long")
    with pytest.raises(PySparkException):
        oc.busy_counts(instants, world[0], world[1]).collect()


def test_timeline_ends_at_zero_and_spans_are_seamless(spark, world):
    steps = oc.usage_steps(world[0], 20_000)
    last = ld.latest_sample(steps.drop("until_ms")).collect()
    assert last and all(r.active_tasks == 0 and r.cpu_cores_used == 0.0 for r in last)
    spans = oc.usage_spans(world[0], world[1], 20_000).collect()
    by_machine = {}
    for s in spans:
        by_machine.setdefault(s.machine_id, []).append((s.from_ms, s.to_ms))
    assert set(by_machine) == set(range(8))
    for parts in by_machine.values():
        parts.sort()
        assert [b for _, b in parts[:-1]] == [a for a, _ in parts[1:]] and parts[-1][1] is None


def test_ledger_books_cost_and_energy_and_shows_unused_machines(spark):
    half_hour = ledger(spark, [(1, 1, 0, 1_800_000, 16.0, 1024.0, 0.0, 8.0)])
    rows = {r.machine_id: r for r in ld.machine_ledger(half_hour, fleet(spark, [machine(1, 4), machine(2, 0)])).collect()}
    assert rows[1].total_cost == pytest.approx(2.75)
    assert rows[1].energy_wh == pytest.approx((16 / 32 * 200 + 1024 / 4096 * 400) * 0.5)
    assert (rows[2].n_tasks, rows[2].total_cost, rows[2].energy_wh) == (0, 0.0, 0.0)


def test_nested_history_flattens_and_unpivots(spark):
    nested = spark.createDataFrame(
        [(1, [(5, 0.5, 0.0, 0.25, 2)])],
        "machine_id long, history array<struct<time: long, cpu_util: double, gpu_util: double, ram_util: double, active_tasks: long>>",
    )
    flat = ld.flatten_history(nested)
    assert flat.first().active_tasks == 2
    long = {r.resource: r.utilization for r in ld.unpivot_utilization(flat, ["machine_id", "time"]).collect()}
    assert long == {"CPU": 50.0, "GPU": 0.0, "RAM": 25.0}


def test_a_millisecond_clock_reaches_today(spark):
    now = 1_700_000_000_123
    fleet_of_two = fleet(spark, [machine(1), machine(2)])
    busy = ledger(spark, [(1, 1, now - 5, now + 5, 1.0, 0.0, 0.0, 1.0)])
    at = spark.createDataFrame([(now,), (now + 5,)], "time_ms long")
    got = {r.time_ms: (r.n_busy, r.n_free, r.first_free_id) for r in oc.busy_counts(at, busy, fleet_of_two, quantum_ms=1).collect()}
    assert got == {now: (1, 1, 2), now + 5: (0, 2, 1)}


def test_an_instant_beyond_the_clock_is_an_error(spark):
    empty = ledger(spark, [(1, 1, 0, 1, 1.0, 0.0, 0.0, 1.0)])
    late = spark.createDataFrame([(3_600_000 << 20,)], "time_ms long")
    with pytest.raises(Exception, match="is not a multiple of"):
        oc.busy_counts(late, empty, fleet(spark, [machine(1)]), quantum_ms=3_600_000, bits=20).collect()


def test_the_first_free_machine_may_come_late(spark, monkeypatch):
    """Machines are tried in small portions; all but a late one are busy at some instants, and none is free at others."""
    monkeypatch.setattr(oc, "FIRST_TRIED", 2)
    monkeypatch.setattr(oc, "WIDEN", 2)
    pool = fleet(spark, [machine(i) for i in range(1, 31)])
    rows = [(i, m, 0, 10_000 if m < 27 else 5000, 1.0, 0.0, 0.0, 1.0) for i, m in enumerate(range(1, 31))]
    rows += [(100 + m, m, 20_000, 30_000, 1.0, 0.0, 0.0, 1.0) for m in range(1, 4)]
    times = spark.createDataFrame([(t,) for t in (0, 4000, 5000, 9000, 10_000, 20_000, 30_000)], "time_ms long")
    got = {r.time_ms: (r.n_busy, r.n_free, r.first_free_id) for r in oc.busy_counts(times, ledger(spark, rows), pool).collect()}
    assert got == {
        0: (30, 0, None), 4000: (30, 0, None), 5000: (26, 4, 27), 9000: (26, 4, 27), 10_000: (0, 30, 1), 20_000: (3, 27, 4),
        30_000: (0, 30, 1),
    }


def test_events_are_dealt_out_once_a_use(spark, world):
    """Neither the grouping by instant nor the running totals send the events again."""
    points = spark.createDataFrame([(m, t) for m in range(6) for t in (0, 7000, 41_000)], "machine_id long, time_ms long")
    for out in (oc.usage_at(points, world[0], True, 20_000), oc.usage_steps(world[0], 20_000)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        moved = [line for line in plan.splitlines() if " Exchange hashpartitioning(" in line and "ReusedExchange" not in line]
        assert not any("time_ms" in line for line in moved)
        # the rows themselves, the sums of buckets, and those along a machine
        assert sum("REPARTITION_BY_COL" in line for line in moved) <= 2 and len(moved) <= 3


@pytest.mark.parametrize("quantum, bits", [(1, 32), (60_000, 20), (3_600_000, 12)])
def test_blocks_without_an_instant_are_left_out(spark, quantum, bits):
    """Only blocks near an instant are kept, also where blocks are smaller than a cell, and the answers are those of the spans."""
    random.seed(bits)
    starts = [random.randrange(0, 90 * 3_600_000) for _ in range(400)]
    rows = [(i % 40, i % 3, s, s + random.randrange(1, 9 * 3_600_000) if i % 7 else None) for i, s in enumerate(starts)]
    instants = [h * 24 * 3_600_000 for h in range(5)]
    spans = spark.createDataFrame(rows, "machine_id long, kind long, from_ms long, to_ms long")
    asked = spark.createDataFrame([(t,) for t in instants], "time_ms long")
    blocks = oc.cover_blocks(spans, quantum, bits)
    kept = oc.asked_only(blocks, asked.withColumn("tick", oc.instant_tick("time_ms", quantum, bits)), bits)
    fine = max(0, bits - oc.CELL_BITS)
    around = {t // quantum >> fine for t in instants}

    def near(size, block):
        return any((c >> max(size - fine, 0)) == (block >> max(fine - size, 0)) for c in around)

    found = [(r.block_size, r.block) for r in blocks.collect()]
    left = [(r.block_size, r.block) for r in kept.collect()]
    assert sorted(left) == sorted(b for b in found if near(*b)) and len(left) < len(found) / 2
    inside = {(t, k): [m for m, c, a, b in rows if c == k and a <= t and (b is None or t < b)] for t in instants for k in range(3)}
    got = {(r.time_ms, r.kind): (r.n_free, r.first_free_id) for r in oc.free_by_class(asked, spans, ["kind"], quantum, bits).collect()}
    assert got == {k: (len(v), min(v)) for k, v in inside.items() if v}
    listed = oc.free_members(asked, spans, ["kind"], quantum, bits).collect()
    assert sorted((r.time_ms, r.kind, r.machine_id) for r in listed) == sorted((*k, m) for k, v in inside.items() for m in v)
