"""Named queries over the star-schema tables, each with SQL for an independent engine where one exists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berthline.functions.numeric import LEHMER_MODULUS, apply_temperature, binarize, lehmer_sql, rounded
from berthline.functions.scoring import PowerOverrides
from berthline.ml.serving import external_scorer
from berthline.operators import candidates as cd
from berthline.operators import intake, ledger as ld, metrics as mt, occupancy as oc, pool, ranking, reports as rp
from berthline.operators import splits
from berthline.plans import fixtures as fx
from berthline.plans import oracle_parts as op
from berthline.plans import placement as pm
from berthline.plans.placement import PlacementRules
from berthline.schemas import (
    FEATURE_COLUMNS, MACHINE_COLUMNS, REQUEST_COLUMNS, SPEC_COLUMNS, SPEC_RANGES, USED, presets,
)
from berthline.plans.training import train_evaluate
from berthline.session import scratch_path
from berthline.sources import files, workload
from berthline.streaming import jobs as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The tables hold whole days and hours over seven years: an hourly clock and monthly buckets suit them.
CLOCK = {"quantum_ms": 3_600_000, "bits": 20}
MONTH_MS = 30 * 86_400_000
SNAPSHOT_MS = 896_659_200_000  # 1998-06-01
RULES = PlacementRules(quantum_ms=CLOCK["quantum_ms"], cover_bits=CLOCK["bits"], bucket_ms=MONTH_MS, model_used="load_share")


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def r6(*names: str) -> list[Column]:
    """Columns at six decimals, by arithmetic that any engine repeats exactly."""
    return [rounded(n).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"floor({n} * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS {n}" for n in names)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# ---- ranking -------------------------------------------------------------------------------

_SCORES = ("watts", "energy_score", "fit_score", "final_score")
_RANKED = "SELECT task_id, rank, machine_id, " + q6(*_SCORES) + " FROM top"


def _ranked(spark: SparkSession, sf: str, **kwargs) -> DataFrame:
    best = ranking.rank_placements(fx.tasks(spark, sf), fx.machines(spark, sf), **kwargs)
    return best.select("task_id", F.col("rank").cast("bigint").alias("rank"), "machine_id", *r6(*_SCORES))


@query(with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ranked(0.5, "floored", 1)) + _RANKED)
def rank_best(spark, sf):
    return _ranked(spark, sf)


@query(with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ranked(0.5, "floored", 10)) + _RANKED)
def rank_topk(spark, sf):
    return _ranked(spark, sf, k=10)


@query(with_ctes(op.MACHINES_CTE, op.FRACTIONAL_TASKS_CTE, op.ranked(0.5, "floored", 3)) + _RANKED)
def rank_pruned(spark, sf):
    """Requests that hardly repeat: classes are ruled out for boxes of requests before pairs are formed."""
    best = ranking.rank_placements(fx.fractional_tasks(spark, sf), fx.machines(spark, sf), k=3, prune=True)
    return best.select("task_id", F.col("rank").cast("bigint").alias("rank"), "machine_id", *r6(*_SCORES))


@query(with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ranked(0.4, "plain", 1)) + _RANKED)
def rank_plain_profile(spark, sf):
    return _ranked(spark, sf, alpha=0.4, profile="plain")


@query(
    with_ctes(
        op.MACHINES_CTE, op.TASKS_CTE, op.ranked(0.4, "plain", 3, {"ram": 0.2, "cpu": 3.0, "gpu": 0.05, "vram": 1.5})
    )
    + _RANKED
)
def rank_overrides(spark, sf):
    return _ranked(
        spark, sf, alpha=0.4, profile="plain", k=3,
        overrides=PowerOverrides(
            ram_power_per_gb=0.2, cpu_power_per_core=3.0, gpu_power_per_core=0.05, gpu_vram_power_per_gb=1.5
        ),
    )


@query(
    with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ranked(0.5, "floored", 1))
    + "SELECT t.task_id, m.machine_id, m.machine_name, m.cost_per_hour FROM top t JOIN machines m USING (machine_id)"
)
def winner_lookup(spark, sf):
    machines = fx.machines(spark, sf)
    best = ranking.rank_placements(fx.tasks(spark, sf), machines).select("task_id", "machine_id")
    named = ranking.winner_lookup(best, machines, ["machine_name", "cost_per_hour"])
    return named.select("task_id", "machine_id", "machine_name", "cost_per_hour")


@query(
    with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ranked(0.5, "floored", 1))
    + """SELECT DISTINCT t.req_cpu_cores, t.req_gpu_cores, t.req_gpu_vram_gb, t.req_ram_gb, round(fmin, 6) AS fit_min,
    round(fmax, 6) AS fit_max, round(wmin, 6) AS watts_min, round(wmax, 6) AS watts_max
    FROM bounds JOIN tasks t USING (task_id)"""
)
def candidate_extrema(spark, sf):
    shapes = cd.request_shapes(fx.tasks(spark, sf)).drop("n_tasks")
    pairs = ranking.with_raw_scores(cd.capable_pairs(shapes, cd.machine_classes(fx.machines(spark, sf))))
    extrema = ranking.candidate_extrema(pairs, REQUEST_COLUMNS)
    return extrema.select(*REQUEST_COLUMNS, *r6("fit_min", "fit_max", "watts_min", "watts_max"))


_FITS = """m.cpu_cores_total - m.cpu_cores_used + CAST(1e-9 AS DOUBLE) >= t.req_cpu_cores
    AND m.gpu_cores_total - m.gpu_cores_used + CAST(1e-9 AS DOUBLE) >= t.req_gpu_cores
    AND m.gpu_vram_total_gb - m.gpu_vram_used_gb + CAST(1e-9 AS DOUBLE) >= t.req_gpu_vram_gb
    AND m.ram_total_gb - m.ram_used_gb + CAST(1e-9 AS DOUBLE) >= t.req_ram_gb"""


@query(
    with_ctes(op.MACHINES_CTE, op.TASKS_CTE)
    + f"SELECT t.task_id, count(m.machine_id) AS n_feasible FROM tasks t LEFT JOIN machines m ON {_FITS} GROUP BY t.task_id"
)
def feasible_counts(spark, sf):
    return cd.feasible_counts(fx.tasks(spark, sf), fx.machines(spark, sf)).select("task_id", "n_feasible")


@query(
    with_ctes(op.MACHINES_CTE, op.TASKS_CTE)
    + "SELECT "
    + ", ".join(f"m.{c}" for c in MACHINE_COLUMNS[:10])
    + ", round(m.current_cpu_power_w, 6) AS current_cpu_power_w, round(m.current_gpu_power_w, 6) AS current_gpu_power_w, "
    + ", ".join(f"t.{c}" for c in REQUEST_COLUMNS)
    + ", min(m.machine_id) AS class_id, count(DISTINCT m.machine_id) AS n_machines"
    + f" FROM (SELECT DISTINCT {', '.join(REQUEST_COLUMNS)} FROM tasks) t JOIN machines m ON {_FITS} GROUP BY ALL"
)
def candidate_features(spark, sf):
    shapes = cd.request_shapes(fx.tasks(spark, sf)).drop("n_tasks")
    pairs = cd.assemble_features(cd.capable_pairs(shapes, cd.machine_classes(fx.machines(spark, sf))))
    return cd.align_features(pairs, FEATURE_COLUMNS, ["class_id", "n_machines"]).withColumns(
        {c: F.round(c, 6) for c in ("current_cpu_power_w", "current_gpu_power_w")}
    )


# ---- occupancy -----------------------------------------------------------------------------

_BUSY = """instants AS (SELECT DISTINCT arrival_ms AS time_ms FROM tasks), busy AS (
  SELECT DISTINCT i.time_ms, a.machine_id FROM instants i
  JOIN allocations a ON a.start_ms <= i.time_ms AND i.time_ms < a.finish_ms
), free AS (
  SELECT i.time_ms, m.* FROM instants i CROSS JOIN machines m
  WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.time_ms = i.time_ms AND b.machine_id = m.machine_id)
)"""
_OCC = with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ALLOCATIONS_CTE, _BUSY)


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tasks(spark, sf).select(F.col("arrival_ms").alias("time_ms"))


@query(
    _OCC
    + """SELECT i.time_ms, (SELECT count(*) FROM machines) - count(f.machine_id) AS n_busy, count(f.machine_id) AS n_free,
    min(f.machine_id) AS first_free_id FROM instants i LEFT JOIN free f USING (time_ms) GROUP BY i.time_ms"""
)
def busy_asof(spark, sf):
    return oc.busy_counts(
        _instants(spark, sf), fx.allocations(spark, sf), fx.machines(spark, sf), **CLOCK, bucket_ms=MONTH_MS
    )


@query(
    _OCC
    + """SELECT time_ms, cpu_cores_total, ram_total_gb, count(*) AS n_free, min(machine_id) AS first_free_id
    FROM free GROUP BY time_ms, cpu_cores_total, ram_total_gb"""
)
def free_asof(spark, sf):
    machines = fx.machines(spark, sf)
    specs = machines.select("machine_id", "cpu_cores_total", "ram_total_gb")
    spans = oc.idle_spans(fx.allocations(spark, sf), machines, MONTH_MS).join(specs, "machine_id")
    return oc.free_by_class(_instants(spark, sf), spans, ["cpu_cores_total", "ram_total_gb"], **CLOCK)


_POINTS = """points AS (SELECT task_id, task_id % (SELECT count(*) FROM supplier) AS machine_id, arrival_ms AS time_ms
  FROM tasks)"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    size = fx.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    return fx.tasks(spark, sf).select(
        "task_id", (F.col("task_id") % size).alias("machine_id"), F.col("arrival_ms").alias("time_ms")
    )


_USED_SUMS = ", ".join(
    f"coalesce(sum(a.{r}), 0) AS {u}"
    for r, u in zip(REQUEST_COLUMNS, ("cpu_cores_used", "gpu_cores_used", "gpu_vram_used_gb", "ram_used_gb"))
)


@query(
    with_ctes(op.TASKS_CTE, op.ALLOCATIONS_CTE, _POINTS)
    + f"""SELECT p.machine_id, p.time_ms, count(a.machine_id) AS active_tasks, {_USED_SUMS}
    FROM (SELECT DISTINCT machine_id, time_ms FROM points) p LEFT JOIN allocations a
    ON a.machine_id = p.machine_id AND a.start_ms <= p.time_ms AND p.time_ms < a.finish_ms GROUP BY p.machine_id, p.time_ms"""
)
def used_asof(spark, sf):
    points = _points(spark, sf).select("machine_id", "time_ms").distinct()
    return oc.usage_at(points, fx.allocations(spark, sf), bucket_ms=MONTH_MS)


@query(
    with_ctes(op.TASKS_CTE, op.ALLOCATIONS_CTE, _POINTS)
    + """SELECT task_id, machine_id, time_ms FROM points p WHERE NOT EXISTS (SELECT 1 FROM allocations a
    WHERE a.machine_id = p.machine_id AND a.start_ms <= p.time_ms AND p.time_ms < a.finish_ms)"""
)
def is_free(spark, sf):
    kept = oc.free_pairs(_points(spark, sf), fx.allocations(spark, sf), MONTH_MS)
    return kept.select("task_id", "machine_id", "time_ms")


@query(
    with_ctes(op.TASKS_CTE, op.ALLOCATIONS_CTE, _POINTS)
    + """SELECT task_id, machine_id, time_ms FROM points p WHERE EXISTS (SELECT 1 FROM allocations a
    WHERE a.machine_id = p.machine_id AND a.start_ms <= p.time_ms AND p.time_ms < a.finish_ms)"""
)
def is_busy(spark, sf):
    kept = oc.busy_pairs(_points(spark, sf), fx.allocations(spark, sf), MONTH_MS)
    return kept.select("task_id", "machine_id", "time_ms")


@query(
    with_ctes(op.MACHINES_CTE, op.TASKS_CTE, op.ALLOCATIONS_CTE, _POINTS)
    + """SELECT p.machine_id, p.time_ms, count(a.machine_id) AS active_tasks,
    round(coalesce(sum(a.req_cpu_cores), 0) / max(m.cpu_cores_total), 6) AS cpu_util,
    round(coalesce(sum(a.req_gpu_cores), 0) / greatest(1, max(m.gpu_cores_total)), 6) AS gpu_util,
    round(coalesce(sum(a.req_ram_gb), 0) / max(m.ram_total_gb), 6) AS ram_util
    FROM (SELECT DISTINCT machine_id, time_ms FROM points) p JOIN machines m USING (machine_id) LEFT JOIN allocations a
    ON a.machine_id = p.machine_id AND a.start_ms < p.time_ms AND p.time_ms < a.finish_ms GROUP BY p.machine_id, p.time_ms"""
)
def tick_samples(spark, sf):
    points = _points(spark, sf).select("machine_id", "time_ms").distinct()
    samples = ld.sample_ticks(points, fx.allocations(spark, sf), fx.machines(spark, sf), MONTH_MS)
    return samples.select("machine_id", "time_ms", "active_tasks", *r6("cpu_util", "gpu_util", "ram_util"))


_TIMELINE = """edges AS (
  SELECT machine_id, start_ms AS time_ms, 1 AS sign, * EXCLUDE (machine_id, start_ms, finish_ms, task_id) FROM allocations
  WHERE finish_ms > start_ms UNION ALL
  SELECT machine_id, finish_ms, -1, * EXCLUDE (machine_id, start_ms, finish_ms, task_id) FROM allocations
  WHERE finish_ms > start_ms
), steps AS (
  SELECT machine_id, time_ms, sum(sign) AS d, sum(sign * req_cpu_cores) AS c, sum(sign * req_gpu_cores) AS g,
    sum(sign * req_ram_gb) AS r FROM edges GROUP BY machine_id, time_ms
), timeline AS (
  SELECT s.machine_id, s.time_ms, CAST(sum(d) OVER w AS BIGINT) AS active_tasks,
    round(sum(c) OVER w / m.cpu_cores_total, 6) AS cpu_util,
    round(sum(g) OVER w / greatest(1, m.gpu_cores_total), 6) AS gpu_util, round(sum(r) OVER w / m.ram_total_gb, 6) AS ram_util
  FROM steps s JOIN machines m USING (machine_id)
  WINDOW w AS (PARTITION BY s.machine_id ORDER BY s.time_ms ROWS UNBOUNDED PRECEDING)
)"""
_TL = with_ctes(op.MACHINES_CTE, op.ALLOCATIONS_CTE, _TIMELINE)


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    wide = oc.utilization_timeline(fx.allocations(spark, sf), fx.machines(spark, sf), MONTH_MS)
    return wide.select("machine_id", "time_ms", "active_tasks", *r6("cpu_util", "gpu_util", "ram_util"))


@query(_TL + "SELECT * FROM timeline")
def utilization_timeline(spark, sf):
    return _timeline(spark, sf)


@query(
    _TL
    + """SELECT machine_id, time_ms, 'CPU' AS resource, round(cpu_util * 100, 6) AS utilization FROM timeline UNION ALL
    SELECT machine_id, time_ms, 'RAM', round(ram_util * 100, 6) FROM timeline UNION ALL
    SELECT machine_id, time_ms, 'GPU', round(gpu_util * 100, 6) FROM timeline"""
)
def utilization_long(spark, sf):
    long = ld.unpivot_utilization(_timeline(spark, sf), ["machine_id", "time_ms"])
    return long.withColumn("utilization", F.round("utilization", 6))


@query(
    _TL
    + "SELECT * FROM timeline QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY time_ms DESC) = 1"
)
def latest_sample(spark, sf):
    return ld.latest_sample(_timeline(spark, sf))


# ---- ledger --------------------------------------------------------------------------------

_LEDGER_OUT = ("busy_hours", "total_cost", "energy_wh")


@query(
    with_ctes(op.MACHINES_CTE, op.ALLOCATIONS_CTE, op.LEDGER_CTE)
    + "SELECT machine_id, machine_name, n_tasks, " + q6(*_LEDGER_OUT) + " FROM ledger"
)
def machine_ledger(spark, sf):
    out = ld.machine_ledger(fx.allocations(spark, sf), fx.machines(spark, sf))
    return out.select("machine_id", "machine_name", "n_tasks", *r6(*_LEDGER_OUT))


_SNAPSHOT = f"""live AS (SELECT * FROM allocations WHERE start_ms <= {SNAPSHOT_MS} AND finish_ms > {SNAPSHOT_MS}), used AS (
  SELECT a.machine_id, count(*) AS active_tasks, {_USED_SUMS} FROM live a GROUP BY a.machine_id
), allocations_until AS (SELECT * FROM allocations WHERE start_ms <= {SNAPSHOT_MS}
), snap AS (
  SELECT m.machine_id, m.machine_name, m.cpu_cores_total, m.ram_total_gb, m.gpu_cores_total, m.cpu_watts, m.gpu_watts,
    coalesce(u.active_tasks, 0) AS active_tasks, coalesce(u.cpu_cores_used, 0) AS cpu_cores_used,
    coalesce(u.gpu_cores_used, 0) AS gpu_cores_used, coalesce(u.gpu_vram_used_gb, 0) AS gpu_vram_used_gb,
    coalesce(u.ram_used_gb, 0) AS ram_used_gb FROM machines m LEFT JOIN used u USING (machine_id)
)"""
_SNAP = with_ctes(
    op.MACHINES_CTE, op.ALLOCATIONS_CTE, _SNAPSHOT,
    op.LEDGER_CTE.replace("LEFT JOIN allocations a", "LEFT JOIN allocations_until a"),
)


@query(
    _SNAP
    + """SELECT s.machine_id, s.active_tasks, s.cpu_cores_used, s.gpu_cores_used, s.gpu_vram_used_gb, s.ram_used_gb,
    round(s.cpu_watts * s.cpu_cores_used / s.cpu_cores_total, 6) AS current_cpu_power_w,
    round(s.gpu_watts * s.gpu_cores_used / greatest(1, s.gpu_cores_total), 6) AS current_gpu_power_w, l.n_tasks,
    round(l.total_cost, 6) AS total_cost, round(l.energy_wh, 6) AS energy_wh FROM snap s JOIN ledger l USING (machine_id)"""
)
def machine_snapshot(spark, sf):
    snap = ld.machine_snapshot(fx.machines(spark, sf), fx.allocations(spark, sf), SNAPSHOT_MS)
    return snap.select(
        "machine_id", "active_tasks", *USED.values(), "n_tasks",
        *r6("current_cpu_power_w", "current_gpu_power_w", "total_cost", "energy_wh"),
    )


@query(
    _SNAP
    + """SELECT machine_id, machine_name, cpu_cores_total, ram_total_gb,
    round(cpu_cores_used / cpu_cores_total * 100, 6) AS utilization_cpu,
    round(ram_used_gb / ram_total_gb * 100, 6) AS utilization_ram, active_tasks FROM snap"""
)
def pool_view(spark, sf):
    snap = ld.machine_snapshot(fx.machines(spark, sf), fx.allocations(spark, sf), SNAPSHOT_MS)
    view = ld.pool_view(snap)
    return view.withColumns({c: F.round(c, 6) for c in ("utilization_cpu", "utilization_ram")})


@query(
    with_ctes(op.TASKS_CTE)
    + """SELECT task_id, row_number() OVER (ORDER BY arrival_ms, task_id) AS task_ord,
    (row_number() OVER (ORDER BY arrival_ms, task_id) - 1) * 2500 AS arrival_ms FROM tasks"""
)
def logical_arrival(spark, sf):
    tasks = fx.tasks(spark, sf).select("task_id", F.col("arrival_ms").alias("came_ms"))
    return ld.logical_arrival(ld.task_ordinal(tasks, "came_ms"), 2.5).select(
        "task_id", "task_ord", "arrival_ms"
    )


# ---- intake and pool -----------------------------------------------------------------------

_CLEAN_SQL = with_ctes(op.TASKS_CTE) + """, raw AS (
  SELECT task_id, CASE WHEN task_id % 7 = 0 THEN 0 ELSE req_cpu_cores END AS req_cpu_cores, req_gpu_cores,
    req_gpu_vram_gb, CASE WHEN task_id % 13 <> 0 THEN req_ram_gb ELSE 0 END AS req_ram_gb, execution_time FROM tasks) """


@query(_CLEAN_SQL.replace(" , raw", ", raw") + "SELECT * FROM raw")
def intake_clean(spark, sf):
    return intake.clean_tasks(fx.raw_tasks(spark, sf), ["task_id"])


@query(
    _CLEAN_SQL + "SELECT * EXCLUDE (execution_time), CAST(30 AS DOUBLE) AS execution_time FROM raw"
)
def intake_default_time(spark, sf):
    return intake.clean_tasks(fx.raw_tasks(spark, sf, with_time=False), ["task_id"])


@query(
    _CLEAN_SQL + """SELECT count(*) AS n_tasks, round(avg(req_cpu_cores), 6) AS avg_cpu, round(avg(req_ram_gb), 6) AS avg_ram
    FROM raw"""
)
def intake_summary(spark, sf):
    summary = intake.workload_summary(intake.clean_tasks(fx.raw_tasks(spark, sf)))
    return summary.select("n_tasks", *r6("avg_cpu", "avg_ram"))


@query(_CLEAN_SQL + "SELECT * FROM raw ORDER BY task_id LIMIT 5")
def intake_preview(spark, sf):
    return intake.preview(intake.clean_tasks(fx.raw_tasks(spark, sf), ["task_id"]), ["task_id"])


def _workload_sql(profile: str) -> str:
    p, base = workload.PROFILES[profile], 42 * 16

    def draw(stream: int, low: int, high: int) -> str:
        return f"CAST({low} + {lehmer_sql('o_orderkey', base + stream)} % {high - low + 1} AS DOUBLE)"

    vram = draw(2, *workload.VRAM_RANGE) if p["gpu"][1] > 0 else "CAST(0 AS DOUBLE)"
    share = f"CAST({lehmer_sql('o_orderkey', base + 4)} AS DOUBLE) / CAST(2147483647 AS DOUBLE)"
    return f"""SELECT o_orderkey AS task_id, '{profile}' AS profile, {draw(0, *p['cpu'])} AS req_cpu_cores,
    {draw(1, *p['gpu'])} AS req_gpu_cores, {vram} AS req_gpu_vram_gb, {draw(3, *p['ram'])} AS req_ram_gb,
    floor((CAST(5 AS DOUBLE) + {share} * CAST(55 AS DOUBLE)) * 100 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE)
    AS execution_time FROM orders"""


@query(" UNION ALL ".join(_workload_sql(p) for p in workload.PROFILES))
def workload_gen(spark, sf):
    keys = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"))
    parts = [
        keys.select("task_id", F.lit(p).alias("profile"), *[
            c.alias(n) for n, c in workload.request_columns(F.col("task_id"), p).items()
        ])
        for p in workload.PROFILES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    with_ctes(op.PRESETS_CTE)
    + f""", units AS (SELECT s_suppkey, p.*, unnest(generate_series(1, 1 + s_suppkey % 3)) AS unit
    FROM supplier JOIN presets p ON p.preset_idx = s_suppkey % 5)
    SELECT row_number() OVER (ORDER BY s_suppkey, unit) AS machine_id,
    preset || '-' || CAST(row_number() OVER (ORDER BY s_suppkey, unit) AS VARCHAR) AS machine_name,
    {', '.join(SPEC_COLUMNS)} FROM units"""
)
def pool_build(spark, sf):
    wanted = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("request_id"), (F.col("s_suppkey") % 5).alias("preset_idx"),
        (1 + F.col("s_suppkey") % 3).alias("count"),
    ).join(F.broadcast(presets(spark).select("preset_idx", "preset")), "preset_idx").drop("preset_idx")
    return pool.build_pool(wanted)


_CUSTOM = {
    "cpu_cores_total": "p_size * 3", "gpu_cores_total": "(p_partkey * 131) % 9000", "gpu_vram_total_gb": "p_partkey % 150",
    "ram_total_gb": "(p_partkey * 7) % 600", "cpu_watts": "(p_partkey * 3) % 450", "gpu_watts": "(p_partkey * 11) % 700",
    "cost_per_hour": "(p_partkey % 120) / CAST(10 AS DOUBLE)",
}


@query(
    "WITH specs AS (SELECT p_partkey AS machine_id, "
    + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CUSTOM.items())
    + " FROM part) SELECT machine_id, 'Custom-' || CAST(machine_id AS VARCHAR) AS machine_name, concat_ws('; ', "
    + ", ".join(
        f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c} outside {lo}..{hi}' END" for c, (lo, hi) in SPEC_RANGES.items()
    )
    + ") AS reasons FROM specs"
)
def pool_validate(spark, sf):
    part = fx.table(spark, sf, "part")
    specs = part.select(
        F.col("p_partkey").alias("machine_id"), F.lit(None).cast("string").alias("machine_name"),
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in _CUSTOM.items()],
    )
    checked = pool.validate_specs(specs)
    return checked.select("machine_id", "machine_name", F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "WITH specs AS (SELECT p_partkey AS machine_id, "
    + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CUSTOM.items())
    + " FROM part), " + op.MACHINES_CTE
    + f" SELECT machine_id, machine_name, {', '.join(SPEC_COLUMNS)} FROM machines UNION ALL "
    + f"SELECT machine_id, 'Custom-' || CAST(machine_id AS VARCHAR), {', '.join(SPEC_COLUMNS)} FROM specs WHERE "
    + " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in SPEC_RANGES.items())
)
def pool_extend(spark, sf):
    part = fx.table(spark, sf, "part")
    specs = part.select(
        F.col("p_partkey").alias("machine_id"), F.lit(None).cast("string").alias("machine_name"),
        *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in _CUSTOM.items()],
    )
    valid, _ = pool.split_valid(specs)
    columns = ["machine_id", "machine_name", *SPEC_COLUMNS]
    return pool.add_machines(fx.machines(spark, sf).select(*columns), valid.select(*columns))


# ---- reports -------------------------------------------------------------------------------

_PL = with_ctes(op.PLACEMENTS_CTE)


@query(
    _PL + "SELECT task_id, machine_id, round(sla_probability, 6) AS sla_probability FROM placements"
    " WHERE status = 'scheduled'"
)
def scheduled_only(spark, sf):
    kept = rp.scheduled_only(fx.placements(spark, sf))
    return kept.select("task_id", "machine_id", *r6("sla_probability"))


@query(
    with_ctes(op.MACHINES_CTE, op.ALLOCATIONS_CTE, op.LEDGER_CTE, op.PLACEMENTS_CTE)
    + """, k AS (SELECT count(*) AS n_tasks, count(*) FILTER (WHERE status = 'scheduled') AS n_scheduled FROM placements)
    SELECT n_tasks, n_scheduled, n_tasks - n_scheduled AS n_failed,
    round(n_scheduled / CAST(n_tasks AS DOUBLE) * 100, 6) AS success_rate,
    round((SELECT sum(total_cost) FROM ledger), 4) AS total_cost, round((SELECT sum(energy_wh) FROM ledger), 4) AS energy_wh
    FROM k"""
)
def run_kpis(spark, sf):
    ledger = ld.machine_ledger(fx.allocations(spark, sf), fx.machines(spark, sf))
    kpis = rp.run_kpis(fx.placements(spark, sf), ledger)
    return kpis.select(
        "n_tasks", "n_scheduled", "n_failed", *r6("success_rate"),
        F.round("total_cost", 4).alias("total_cost"), F.round("energy_wh", 4).alias("energy_wh"),
    )


@query(
    with_ctes(
        op.MACHINES_CTE, op.ALLOCATIONS_CTE, _SNAPSHOT,
        op.LEDGER_CTE.replace("LEFT JOIN allocations a", "LEFT JOIN allocations_until a"), op.PLACEMENTS_CTE,
    )
    + """SELECT (SELECT count(*) FROM snap) AS n_machines, (SELECT count(*) FROM snap WHERE active_tasks > 0) AS n_busy,
    (SELECT count(*) FROM placements WHERE status = 'scheduled') AS n_scheduled,
    (SELECT round(sum(energy_wh), 4) FROM ledger) AS energy_wh"""
)
def fleet_kpis(spark, sf):
    snap = ld.machine_snapshot(fx.machines(spark, sf), fx.allocations(spark, sf), SNAPSHOT_MS)
    return rp.fleet_kpis(snap, fx.placements(spark, sf)).withColumn("energy_wh", F.round("energy_wh", 4))


@query(
    _PL
    + """SELECT model_used, count(*) FILTER (WHERE status = 'scheduled') AS n_scheduled, count(*) AS n_tasks,
    round(count(*) FILTER (WHERE status = 'scheduled') / CAST(count(*) AS DOUBLE) * 100, 6) AS success_rate
    FROM placements GROUP BY model_used"""
)
def model_comparison(spark, sf):
    return rp.model_comparison(fx.placements(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@query(
    _PL
    + """SELECT machine_id, count(*) AS n_tasks, round(count(*) / CAST((SELECT count(*) FROM placements
    WHERE status = 'scheduled') AS DOUBLE) * 100, 6) AS share_pct FROM placements WHERE status = 'scheduled'
    GROUP BY machine_id"""
)
def task_distribution(spark, sf):
    return rp.task_distribution(fx.placements(spark, sf)).withColumn("share_pct", F.round("share_pct", 6))


@query(
    _PL
    + """SELECT round(avg(sla_probability), 6) AS avg_sla, count(*) FILTER (WHERE sla_probability > CAST(0.5 AS DOUBLE))
    AS n_high_risk, round(avg(energy_score), 6) AS avg_energy_score, round(avg(fit_score), 6) AS avg_fit_score
    FROM placements WHERE status = 'scheduled'"""
)
def risk_summary(spark, sf):
    out = rp.risk_summary(fx.placements(spark, sf))
    return out.select(*r6("avg_sla"), "n_high_risk", *r6("avg_energy_score", "avg_fit_score"))


@query(
    _PL
    + """SELECT task_id, round(sla_probability, 6) AS sla_probability FROM placements
    WHERE sla_probability > CAST(0.5 AS DOUBLE)"""
)
def high_risk(spark, sf):
    return rp.high_risk(fx.placements(spark, sf)).select("task_id", *r6("sla_probability"))


@query(
    _PL
    + """, b AS (SELECT least(greatest(CAST(floor(sla_probability * 20) AS INT), 0), 19) AS bin, count(*) AS n
    FROM placements WHERE sla_probability IS NOT NULL GROUP BY 1)
    SELECT CAST(r.bin AS INT) AS bin, r.bin / CAST(20 AS DOUBLE) AS bin_start, coalesce(b.n, 0) AS n
    FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN b ON b.bin = r.bin"""
)
def sla_histogram(spark, sf):
    return rp.sla_histogram(fx.placements(spark, sf))


@query(
    _PL
    + """, q AS (SELECT model_used, count(*) AS n, min(sla_probability) AS p_min,
      quantile_cont(sla_probability, 0.25) AS q1, quantile_cont(sla_probability, 0.5) AS median,
      quantile_cont(sla_probability, 0.75) AS q3, max(sla_probability) AS p_max
      FROM placements WHERE status = 'scheduled' GROUP BY model_used)
    SELECT q.model_used, max(n) AS n, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3,
      round(max(p_min), 6) AS p_min, round(max(p_max), 6) AS p_max, round(min(p.sla_probability), 6) AS fence_low,
      round(max(p.sla_probability), 6) AS fence_high
    FROM q JOIN placements p ON p.model_used = q.model_used AND p.status = 'scheduled'
      AND p.sla_probability BETWEEN q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AND q3 + CAST(1.5 AS DOUBLE) * (q3 - q1)
    GROUP BY q.model_used"""
)
def sla_box_stats(spark, sf):
    out = rp.sla_box_stats(fx.placements(spark, sf))
    return out.select("model_used", "n", *r6("q1", "median", "q3", "p_min", "p_max", "fence_low", "fence_high"))


@query(
    _PL
    + "SELECT task_id, round(energy_score, 6) AS energy_score, round(fit_score, 6) AS fit_score FROM placements"
    " WHERE status = 'scheduled'"
)
def energy_vs_fit(spark, sf):
    return rp.energy_vs_fit(fx.placements(spark, sf)).select("task_id", *r6("energy_score", "fit_score"))


@query(
    _PL
    + """SELECT least(greatest(CAST(floor(energy_score * 20) AS INT), 0), 19) AS energy_bin,
    least(greatest(CAST(floor(fit_score * 20) AS INT), 0), 19) AS fit_bin, count(*) AS n
    FROM placements WHERE status = 'scheduled' GROUP BY 1, 2"""
)
def energy_fit_density(spark, sf):
    return rp.energy_fit_density(fx.placements(spark, sf))


@query(
    _PL
    + """SELECT task_id, status, machine_id, round(energy_score, 3) AS energy_score FROM placements
    ORDER BY task_id DESC LIMIT 10"""
)
def recent_log(spark, sf):
    shown = rp.format_scores(rp.recent_log(fx.placements(spark, sf)), ["energy_score"])
    return shown.select("task_id", "status", "machine_id", "energy_score")


@query(
    _PL + "SELECT task_id, round(energy_score, 6) AS energy_score FROM placements WHERE energy_score IS NOT NULL"
)
def drop_non_numeric(spark, sf):
    text = fx.placements(spark, sf).select(
        "task_id", F.coalesce(F.col("energy_score").cast("string"), F.lit("N/A")).alias("energy_score")
    )
    return rp.drop_non_numeric(text, ["energy_score"]).select("task_id", *r6("energy_score"))


# ---- classifier quality --------------------------------------------------------------------

_SC = with_ctes(op.SCORED_CTE)
_COUNTS = """count(*) FILTER (WHERE y = 0 AND NOT hit) AS tn, count(*) FILTER (WHERE y = 0 AND hit) AS fp,
    count(*) FILTER (WHERE y = 1 AND NOT hit) AS fn, count(*) FILTER (WHERE y = 1 AND hit) AS tp"""
_QUALITY = """round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
    round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS "precision",
    round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall,
    round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1"""
_QUALITY_NAMES = ("accuracy", "precision", "recall", "f1")


@query(_SC + f", h AS (SELECT *, p >= CAST(0.5 AS DOUBLE) AS hit FROM scored) SELECT model_used, {_COUNTS} FROM h GROUP BY 1")
def confusion(spark, sf):
    return mt.confusion_matrix(fx.scored(spark, sf), keys=["model_used"])


@query(
    _SC
    + f""", h AS (SELECT *, p > CAST(0.55 AS DOUBLE) AS hit FROM scored), c AS (SELECT model_used, {_COUNTS} FROM h GROUP BY 1)
    SELECT *, {_QUALITY} FROM c"""
)
def class_metrics(spark, sf):
    out = mt.classification_metrics(fx.scored(spark, sf), 0.55, strict=True, keys=["model_used"])
    return out.withColumns({c: F.round(c, 6) for c in _QUALITY_NAMES})


@query(
    _SC
    + f""", h AS (SELECT *, p >= CAST(0.5 AS DOUBLE) AS hit FROM scored), c AS (SELECT {_COUNTS} FROM h), k AS (
      SELECT '0' AS class, coalesce(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 0) AS pr, coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0) AS re,
        coalesce(2 * tn / CAST(nullif(2 * tn + fn + fp, 0) AS DOUBLE), 0) AS f, tn + fp AS support FROM c UNION ALL
      SELECT '1', coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0),
        coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), tp + fn FROM c)
    SELECT class, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1, support FROM k UNION ALL
    SELECT 'accuracy', a, a, a, n FROM (SELECT round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS a, tn + fp + fn + tp AS n FROM c)
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM k UNION ALL
    SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
      round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM k"""
)
def class_report(spark, sf):
    return mt.classification_report(fx.scored(spark, sf)).select("class", *r6("precision", "recall", "f1"), "support")


_CURVE = """, s AS (SELECT model_used, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
    FROM scored GROUP BY 1, 2), c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp
    FROM s WINDOW w AS (PARTITION BY model_used ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), t AS (
    SELECT model_used, CAST(sum(pos) AS DOUBLE) AS np, CAST(sum(neg) AS DOUBLE) AS nn FROM s GROUP BY 1)"""


@query(_SC + _CURVE + "SELECT model_used, round(p, 6) AS p, pos, neg, tp, fp FROM c")
def cumulative_confusion(spark, sf):
    out = mt.cumulative_confusion(fx.scored(spark, sf), ["model_used"])
    return out.select("model_used", *r6("p"), "pos", "neg", "tp", "fp")


@query(
    _SC + _CURVE
    + """SELECT model_used, round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / max(np * nn), 6) AS roc_auc
    FROM c JOIN t USING (model_used) GROUP BY 1"""
)
def roc_auc(spark, sf):
    return mt.roc_auc(fx.scored(spark, sf), ["model_used"]).select("model_used", *r6("roc_auc"))


@query(
    _SC + _CURVE
    + """SELECT model_used, round(sum(pos / np * (tp / CAST(tp + fp AS DOUBLE))), 6) AS average_precision
    FROM c JOIN t USING (model_used) GROUP BY 1"""
)
def average_precision(spark, sf):
    return mt.average_precision(fx.scored(spark, sf), ["model_used"]).select("model_used", *r6("average_precision"))


@query(
    _SC + "SELECT model_used, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM scored GROUP BY 1"
)
def log_loss(spark, sf):
    return mt.log_loss(fx.scored(spark, sf), ["model_used"]).select("model_used", *r6("log_loss"))


_STEP = (mt.THRESHOLD_HIGH - mt.THRESHOLD_LOW) / (mt.N_THRESHOLDS - 1)
_SWEEP = f""", g AS (SELECT CAST({mt.THRESHOLD_LOW} AS DOUBLE) + k * CAST({_STEP!r} AS DOUBLE) AS threshold FROM (SELECT unnest(range(99)) AS k)),
    h AS (SELECT threshold, y, p >= threshold AS hit FROM scored CROSS JOIN g),
    c AS (SELECT threshold, {_COUNTS} FROM h GROUP BY 1), sweep AS (SELECT threshold AS raw_threshold, round(threshold, 6) AS threshold, tn, fp, fn, tp, {_QUALITY} FROM c)"""


@query(_SC + _SWEEP + "SELECT * EXCLUDE (raw_threshold) FROM sweep")
def threshold_sweep(spark, sf):
    out = mt.threshold_sweep(fx.scored(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", *_QUALITY_NAMES)})


def _pick(recall_target: float) -> str:
    return (
        _SC + _SWEEP
        + f""", z AS (SELECT *, recall >= CAST({recall_target} AS DOUBLE) AS ok FROM sweep)
    SELECT threshold, tn, fp, fn, tp, accuracy, "precision", recall, f1,
    CASE WHEN ok THEN '{mt.RULE_RECALL}' ELSE '{mt.RULE_F1}' END AS rule FROM z
    ORDER BY ok DESC, CASE WHEN ok THEN "precision" ELSE f1 END DESC, CASE WHEN ok THEN recall ELSE 0 END DESC,
    CASE WHEN ok THEN f1 ELSE 0 END DESC, raw_threshold LIMIT 1"""
    )


def _picked(spark: SparkSession, sf: str, recall_target: float) -> DataFrame:
    out = mt.pick_threshold(fx.scored(spark, sf), recall_target)
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", *_QUALITY_NAMES)})


@query(_pick(0.9))
def pick_threshold(spark, sf):
    return _picked(spark, sf, 0.9)


@query(_pick(1.01))
def pick_threshold_fallback(spark, sf):
    return _picked(spark, sf, 1.01)


_TSTEP = (mt.TEMPERATURE_HIGH - mt.TEMPERATURE_LOW) / (mt.N_TEMPERATURES - 1)
_TEMPS = f""", tg AS (SELECT CAST(0.5 AS DOUBLE) + k * CAST({_TSTEP!r} AS DOUBLE) AS temperature FROM (SELECT unnest(range(91)) AS k)),
    s AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY 1),
    q AS (SELECT temperature, pos, neg, 1 / (1 + exp(-ln(p / (1 - p)) / temperature)) AS q FROM s CROSS JOIN tg),
    ll AS (SELECT temperature, sum(-ln(q) * pos - ln(1 - q) * neg) / sum(pos + neg) AS log_loss FROM q GROUP BY 1)"""


@query(_SC + _TEMPS + "SELECT round(temperature, 6) AS temperature, round(log_loss, 6) AS log_loss FROM ll")
def temperature_sweep(spark, sf):
    return mt.temperature_sweep(fx.scored(spark, sf)).select(*r6("temperature", "log_loss"))


@query(
    _SC + _TEMPS
    + "SELECT round(temperature, 6) AS temperature, round(log_loss, 6) AS log_loss FROM ll ORDER BY ll.log_loss, ll.temperature LIMIT 1"
)
def fit_temperature(spark, sf):
    return mt.fit_temperature(fx.scored(spark, sf)).select(*r6("temperature", "log_loss"))


@query(
    _SC
    + """SELECT row_id, round(1 / (1 + exp(-ln(p / (1 - p)) / CAST(0.9 AS DOUBLE))), 6) AS p_calibrated,
    CASE WHEN p < CAST(0.5 AS DOUBLE) THEN 0 ELSE 1 END AS predicted FROM scored"""
)
def calibrated_scores(spark, sf):
    return fx.scored(spark, sf).select(
        "row_id", F.round(apply_temperature("p", 0.9), 6).alias("p_calibrated"), binarize("p").alias("predicted")
    )


@query(_SC + "SELECT row_id, round(p, 6) AS p FROM scored WHERE p < CAST(0.5 AS DOUBLE)")
def sla_safe(spark, sf):
    return fx.scored(spark, sf).filter(binarize("p", RULES.tau) == 0).select("row_id", *r6("p"))


@query(
    _SC
    + """SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
    round(sum(1 - y) / CAST(greatest(1, sum(y)) AS DOUBLE), 6) AS pos_weight FROM scored"""
)
def class_balance(spark, sf):
    return mt.class_balance(fx.scored(spark, sf)).withColumn("pos_weight", F.round("pos_weight", 6))


@query(
    _SC + _CURVE
    + f""", h AS (SELECT *, p >= CAST(0.59 AS DOUBLE) AS hit FROM scored), m AS (SELECT model_used, {_COUNTS} FROM h GROUP BY 1),
    a AS (SELECT model_used, round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / max(np * nn), 6) AS roc_auc,
      round(sum(pos / np * (tp / CAST(tp + fp AS DOUBLE))), 6) AS average_precision FROM c JOIN t USING (model_used) GROUP BY 1)
    SELECT m.*, {_QUALITY}, CAST(0.59 AS DOUBLE) AS threshold, roc_auc, average_precision FROM m JOIN a USING (model_used)"""
)
def evaluate_report(spark, sf):
    out = mt.evaluate_report(fx.scored(spark, sf), 0.59, ["model_used"])
    return out.withColumns({c: F.round(c, 6) for c in (*_QUALITY_NAMES, "roc_auc", "average_precision")})


# ---- splits and features -------------------------------------------------------------------


@query(
    _SC
    + f""", o AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {lehmer_sql('row_id', 42)}, row_id) AS rn,
      count(*) OVER (PARTITION BY y) AS n FROM scored)
    SELECT row_id, y, rn <= floor(n * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS is_val FROM o"""
)
def stratified_split(spark, sf):
    return splits.stratified_split(fx.scored(spark, sf).select("row_id", "y"), "y", "row_id")


@query(_SC + f"SELECT row_id, {lehmer_sql('row_id', 42)} < {int(0.2 * 2147483647)} AS is_val FROM scored")
def random_split(spark, sf):
    return splits.random_split(fx.scored(spark, sf).select("row_id"), "row_id")


@query(
    _SC
    + f"""SELECT row_id, y, CAST(row_number() OVER (PARTITION BY y ORDER BY {lehmer_sql('row_id', 42)}, row_id) % 3 AS INT)
    AS fold FROM scored"""
)
def assign_folds(spark, sf):
    return splits.assign_folds(fx.scored(spark, sf).select("row_id", "y"), "y", "row_id")


_FT = with_ctes(op.FEATURES_CTE)


@query(
    _FT + "SELECT row_id, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6)"
        f" AS {c}" for c in FEATURE_COLUMNS
    )
    + " FROM features"
)
def scale_features(spark, sf):
    out = splits.standard_scale(fx.features(spark, sf).drop("sla_violation"), FEATURE_COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in FEATURE_COLUMNS})


@query(
    _FT + "SELECT row_id, req_ram_gb, cpu_cores_total, CAST(0 AS DOUBLE) AS not_measured FROM features"
)
def align_features(spark, sf):
    return cd.align_features(
        fx.features(spark, sf), ["req_ram_gb", "cpu_cores_total", "not_measured"], ["row_id"]
    )


@query(_FT + "SELECT row_id, " + q6(*FEATURE_COLUMNS) + " FROM features WHERE sla_violation = 0")
def compliant_tasks(spark, sf):
    data = fx.features(spark, sf)
    kept = files.compliant_tasks(data.drop("sla_violation"), data.select("row_id", "sla_violation"))
    return kept.select("row_id", *r6(*FEATURE_COLUMNS))


# ---- placement -----------------------------------------------------------------------------


def load_share(pairs: DataFrame) -> DataFrame:
    """A scorer that needs no training: risk grows with the share of the machine asked for."""
    p = (
        F.lit(0.05)
        + F.lit(0.5) * F.col("req_cpu_cores") / F.col("cpu_cores_total")
        + F.lit(0.3) * F.col("req_ram_gb") / F.col("ram_total_gb")
        + F.lit(0.2) * F.col("req_gpu_cores") / F.greatest(F.lit(1.0), F.col("gpu_cores_total"))
    )
    return pairs.withColumn("p", F.least(F.lit(0.95), p))


_PLACE = f""", cand AS (
  SELECT t.task_id, f.machine_id, least(CAST(0.95 AS DOUBLE), CAST(0.05 AS DOUBLE)
      + CAST(0.5 AS DOUBLE) * t.req_cpu_cores / f.cpu_cores_total + CAST(0.3 AS DOUBLE) * t.req_ram_gb / f.ram_total_gb
      + CAST(0.2 AS DOUBLE) * t.req_gpu_cores / greatest(1, f.gpu_cores_total)) AS p,
    (abs(f.cpu_cores_total - t.req_cpu_cores) / f.cpu_cores_total
      + abs(f.gpu_cores_total - t.req_gpu_cores) / greatest(f.gpu_cores_total, CAST(1e-9 AS DOUBLE))
      + abs(f.gpu_vram_total_gb - t.req_gpu_vram_gb) / greatest(f.gpu_vram_total_gb, CAST(1e-9 AS DOUBLE))
      + abs(f.ram_total_gb - t.req_ram_gb) / f.ram_total_gb) / 4 AS fit_raw,
    greatest(CAST(0.1 AS DOUBLE), greatest(1, f.cpu_watts / greatest(f.cpu_cores_total, 1)) * t.req_cpu_cores
      + CASE WHEN f.gpu_cores_total > 0 THEN greatest(CAST(0.1 AS DOUBLE), f.gpu_watts / greatest(f.gpu_cores_total, 1)) ELSE 0 END * t.req_gpu_cores
      + CASE WHEN f.gpu_vram_total_gb > 0 THEN greatest(CAST(0.5 AS DOUBLE), f.gpu_watts / greatest(f.gpu_vram_total_gb, 1)) ELSE 0 END * t.req_gpu_vram_gb
      + CAST(0.5 AS DOUBLE) * t.req_ram_gb) AS watts
  FROM tasks t JOIN free f ON f.time_ms = t.arrival_ms AND f.cpu_cores_total >= t.req_cpu_cores
    AND f.gpu_cores_total >= t.req_gpu_cores AND f.gpu_vram_total_gb >= t.req_gpu_vram_gb AND f.ram_total_gb >= t.req_ram_gb
), gate AS (
  SELECT task_id, count(*) AS n_fit, count(*) FILTER (WHERE p < CAST(0.5 AS DOUBLE)) AS n_safe FROM cand GROUP BY 1
), bounds AS (
  SELECT *, min(fit_raw) OVER w AS fmin, max(fit_raw) OVER w AS fmax, min(watts) OVER w AS wmin, max(watts) OVER w AS wmax
  FROM cand WHERE p < CAST(0.5 AS DOUBLE) WINDOW w AS (PARTITION BY task_id)
), normed AS (
  SELECT task_id, machine_id, p, watts,
    CASE WHEN wmax - wmin < CAST(0.01 AS DOUBLE) THEN watts / wmax ELSE (watts - wmin) / (wmax - wmin) END AS energy_score,
    CASE WHEN fmax - fmin < CAST(1e-9 AS DOUBLE) THEN fit_raw ELSE (fit_raw - fmin) / (fmax - fmin) END AS fit_score FROM bounds
), best AS (
  SELECT *, CAST(0.5 AS DOUBLE) * energy_score + CAST(0.5 AS DOUBLE) * fit_score AS final_score FROM normed
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY floor((CAST(0.5 AS DOUBLE) * energy_score + CAST(0.5 AS DOUBLE) * fit_score) * 1e9 + 0.5),
    floor(watts * 1e9 + 0.5), floor(fit_score * 1e9 + 0.5), machine_id) = 1
), placed AS (
  SELECT t.task_id, CASE WHEN coalesce(nf.n, 0) = 0 THEN 'no_free_machine'
      WHEN coalesce(g.n_fit, 0) = 0 THEN 'no_suitable_free_machine'
      WHEN g.n_safe = 0 THEN 'all_predict_violation' ELSE 'scheduled' END AS status,
    b.machine_id, round(b.p, 6) AS sla_probability, round(b.watts, 6) AS watts, round(b.energy_score, 6) AS energy_score,
    round(b.fit_score, 6) AS fit_score, round(b.final_score, 6) AS final_score, 'load_share' AS model_used
  FROM tasks t LEFT JOIN (SELECT time_ms, count(*) AS n FROM free GROUP BY 1) nf ON nf.time_ms = t.arrival_ms
  LEFT JOIN gate g USING (task_id) LEFT JOIN best b USING (task_id)
)"""


def _placed(spark: SparkSession, sf: str, rules: PlacementRules = RULES) -> DataFrame:
    placed = pm.place_snapshot(
        fx.tasks(spark, sf), fx.machines(spark, sf), fx.allocations(spark, sf), load_share, rules
    )
    return placed.withColumns({c: F.round(c, 6) for c in ("sla_probability", *_SCORES)})


@query(_OCC + _PLACE + " SELECT * FROM placed")
def place_snapshot(spark, sf):
    return _placed(spark, sf)


@query(_OCC + _PLACE + " SELECT status, count(*) AS n_tasks FROM placed GROUP BY status")
def placement_status(spark, sf):
    return _placed(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"))


_SNAP_MACHINES = _SNAP + """, machines_at AS (SELECT machine_id, cpu_cores_total, cpu_watts, gpu_cores_total, gpu_watts,
    ram_total_gb, gpu_vram_total_gb, cpu_cores_used, gpu_cores_used, gpu_vram_used_gb, ram_used_gb FROM snap JOIN
    (SELECT machine_id, gpu_vram_total_gb FROM machines) USING (machine_id)), """


@query(
    _SNAP_MACHINES + op.TASKS_CTE + ", " + op.ranked(0.5, "floored", 1).replace("JOIN machines m", "JOIN machines_at m")
    + _RANKED
)
def rank_snapshot(spark, sf):
    """Ranking beside the tasks that already run: usage from the ledger at one instant."""
    fleet = ld.machine_snapshot(fx.machines(spark, sf), fx.allocations(spark, sf), SNAPSHOT_MS)
    best = ranking.rank_placements(fx.tasks(spark, sf), fleet)
    return best.select("task_id", F.col("rank").cast("bigint").alias("rank"), "machine_id", *r6(*_SCORES))


# Task by task within each instant: the best safe machine that no earlier task of the instant took.
_ASSIGN = (_OCC + _PLACE).replace("WITH ", "WITH RECURSIVE ", 1) + """, choice AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY floor(final_score * 1e9 + 0.5), floor(watts * 1e9 + 0.5),
    floor(fit_score * 1e9 + 0.5), machine_id) AS ord
  FROM (SELECT *, CAST(0.5 AS DOUBLE) * energy_score + CAST(0.5 AS DOUBLE) * fit_score AS final_score FROM normed) x
), numbered AS (
  SELECT task_id, arrival_ms, row_number() OVER (PARTITION BY arrival_ms ORDER BY task_id) AS rn FROM tasks
), walk AS (
  SELECT arrival_ms, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS task_id,
    CAST(NULL AS BIGINT) AS machine_id FROM numbered WHERE rn = 1
  UNION ALL
  SELECT arrival_ms, rn, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END, task_id, m FROM (
    SELECT w.arrival_ms, n.rn, w.used, n.task_id, arg_min(c.machine_id, c.ord) AS m
    FROM walk w JOIN numbered n ON n.arrival_ms = w.arrival_ms AND n.rn = w.rn + 1
    LEFT JOIN choice c ON c.task_id = n.task_id AND NOT list_contains(w.used, c.machine_id)
    GROUP BY w.arrival_ms, n.rn, w.used, n.task_id) y
) SELECT w.task_id, w.arrival_ms, CASE WHEN w.machine_id IS NULL THEN 'unassigned' ELSE 'assigned' END AS status, w.machine_id,
    floor(c.p * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS sla_probability,
    floor(c.final_score * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS final_score
  FROM walk w LEFT JOIN choice c ON c.task_id = w.task_id AND c.machine_id = w.machine_id WHERE w.task_id IS NOT NULL"""


@query(_ASSIGN)
def batch_assign(spark, sf):
    out = pm.batch_assign(fx.tasks(spark, sf), fx.machines(spark, sf), fx.allocations(spark, sf), load_share, RULES)
    return out.select("task_id", "arrival_ms", "status", "machine_id", *r6("sla_probability", "final_score"))


# ---- streams: run to the end of the table, then read what was written ------------------------


def _run(spark: SparkSession, name: str, result: DataFrame, mode: str = "append") -> str:
    path = scratch_path(spark, name)
    st.start(result, st.append_to(path), scratch_path(spark, f"{name}-state"), mode).awaitTermination()
    return path


@query(ORACLES["place_snapshot"])
def stream_place(spark, sf):
    path = scratch_path(spark, "stream_place")
    ledger = st.write_ledger(fx.allocations(spark, sf), scratch_path(spark, "ledger"), 12 * MONTH_MS)
    st.place_stream(
        fx.tasks_of(fx.table_stream(spark, sf, "orders")), fx.machines(spark, sf),
        lambda first, last: st.read_active(spark, ledger, first, last, 12 * MONTH_MS), load_share, RULES, path,
        scratch_path(spark, "stream_place-state"), ranged=True,
    ).awaitTermination()
    placed = spark.read.parquet(path).drop("batch_id")
    return placed.withColumns({c: F.round(c, 6) for c in ("sla_probability", *_SCORES)})


@query(
    _PL + """SELECT status, count(*) AS n_tasks, count(*) FILTER (WHERE status = 'scheduled') AS n_scheduled
    FROM placements GROUP BY status"""
)
def stream_kpis(spark, sf):
    live = st.live_kpis(fx.with_status(fx.scored_of(fx.table_stream(spark, sf, "orders"))))
    return st.read_newest(spark, _run(spark, "stream_kpis", live, "update"), live.schema, ["status"])


_SAMPLES = """WITH samples AS (SELECT user_id AS machine_id, epoch_us(ts) // 1000 AS ms,
    CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS cpu_util FROM events)"""


@query(
    _SAMPLES
    + """SELECT machine_id, ms // 3600000 * 3600000 AS window_start_ms, count(*) AS n, round(avg(cpu_util), 6) AS avg_cpu,
    max(cpu_util) AS max_cpu FROM samples GROUP BY 1, 2
    HAVING window_start_ms + 3600000 <= (SELECT max(ms) FROM samples) - 600000"""
)
def stream_windows(spark, sf):
    samples = fx.utilization_events(fx.table_stream(spark, sf, "events"))
    windows = st.utilization_windows(samples).select(
        "machine_id", F.unix_millis("window_start").alias("window_start_ms"), "n",
        F.round("avg_cpu", 6).alias("avg_cpu"), "max_cpu",
    )
    path = _run(spark, "stream_windows", windows)
    return st.read_appended(spark, path, windows.schema)


@query(
    _SAMPLES
    + """SELECT machine_id, ms // 900000 * 900000 - off * 900000 AS window_start_ms, count(*) AS n,
    max(cpu_util) AS max_cpu FROM samples CROSS JOIN (SELECT unnest(range(4)) AS off) GROUP BY 1, 2
    HAVING window_start_ms + 3600000 <= (SELECT max(ms) FROM samples) - 600000"""
)
def stream_windows_sliding(spark, sf):
    samples = fx.utilization_events(fx.table_stream(spark, sf, "events"))
    windows = st.utilization_windows(samples, slide="15 minutes").select(
        "machine_id", F.unix_millis("window_start").alias("window_start_ms"), "n", "max_cpu"
    )
    path = _run(spark, "stream_sliding", windows)
    return st.read_appended(spark, path, windows.schema)


@query(
    _SAMPLES
    + """SELECT machine_id, ms AS ts_ms, cpu_util FROM samples
    QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ms DESC) = 1"""
)
def stream_latest(spark, sf):
    live = st.live_latest(fx.utilization_events(fx.table_stream(spark, sf, "events"))).select(
        "machine_id", F.unix_millis("ts").alias("ts_ms"), "cpu_util"
    )
    return st.read_newest(spark, _run(spark, "stream_latest", live, "update"), live.schema, ["machine_id"])


@query(
    with_ctes(op.ALLOCATIONS_CTE)
    + """SELECT machine_id, task_id, finish_ms AS released_ms FROM allocations
    WHERE finish_ms <= (SELECT max(start_ms) FROM allocations) - 600000"""
)
def stream_occupancy(spark, sf):
    stream = fx.allocations_of(fx.table_stream(spark, sf, "lineitem")).select(
        "machine_id", "task_id", F.timestamp_millis("start_ms").alias("start"), "finish_ms"
    )
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, st.ROCKSDB)
    try:
        path = _run(spark, "stream_occupancy", st.occupancy_state(stream))
    finally:
        spark.conf.set(setting, before)
    return st.read_appended(spark, path, st.RELEASE_SCHEMA)


# ---- classifiers ---------------------------------------------------------------------------


def _train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = splits.random_split(fx.features(spark, sf), "row_id", 1 / 3, seed=7)
    return rows.filter("NOT is_val").drop("is_val"), rows.filter("is_val").drop("is_val")


# The rows of each split follow from hashes of their ids; what a model learnt is held against the majority class.
_SPLITS = _FT + f""", parted AS (SELECT row_id, sla_violation AS y, {lehmer_sql('row_id', 7)} < {int(LEHMER_MODULUS / 3)} AS test FROM features),
    dealt AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY {lehmer_sql('row_id', 42)}, row_id) AS rn,
      count(*) OVER (PARTITION BY y) AS n FROM parted WHERE NOT test),
    split AS (SELECT 'test' AS split, y FROM parted WHERE test UNION ALL
      SELECT 'val', y FROM dealt WHERE rn <= floor(n * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)))
    SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, TRUE AS above_majority, TRUE AS threshold_on_grid
    FROM split GROUP BY split"""


def _checked(metrics: DataFrame) -> DataFrame:
    n, n_pos = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("fn") + F.col("tp")
    grid = F.round((F.col("threshold") - mt.THRESHOLD_LOW) / _STEP, 6)
    return metrics.select(
        "split", n.alias("n"), n_pos.alias("n_pos"),
        (F.col("accuracy") > F.greatest(n_pos, n - n_pos) / n).alias("above_majority"),
        (F.round(grid) == grid).alias("threshold_on_grid"),
    )


def _trained(spark: SparkSession, sf: str, kind: str, **kwargs) -> DataFrame:
    return _checked(train_evaluate(kind, *_train_test(spark, sf), **kwargs).metrics)


@query(_SPLITS)
def train_lr(spark, sf):
    return _trained(spark, sf, "lr")


@query(_SPLITS)
def train_rf(spark, sf):
    """The forest preset; the search over its grid takes hours on one machine and is not registered."""
    return _trained(spark, sf, "rf")


@query(_SPLITS)
def train_gbt(spark, sf):
    return _trained(spark, sf, "xgb")


@query(_SPLITS)
def train_lgbm(spark, sf):
    return _trained(spark, sf, "lgbm")


@query(_SPLITS)
def train_cat(spark, sf):
    return _trained(spark, sf, "cat")


@query(_SPLITS)
def train_ada(spark, sf):
    """The smallest setting of the grid."""
    return _trained(spark, sf, "ada", rounds=100)


@query(_SPLITS)
def train_mlp(spark, sf):
    return _trained(spark, sf, "mlp")


EXTERNAL_WEIGHTS = {"req_cpu_cores": 0.4, "cpu_cores_total": -0.1, "req_ram_gb": 0.05, "ram_total_gb": -0.01}


def _load_external():
    return {"weights": EXTERNAL_WEIGHTS, "bias": -0.5}


def _predict_external(model, batch):
    z = sum(batch[c].to_numpy() * w for c, w in model["weights"].items()) + model["bias"]
    return 1.0 / (1.0 + np.exp(-z))


@query(
    _FT
    + "SELECT row_id, round(1 / (1 + exp(-("
    + " + ".join(f"{c} * CAST({w} AS DOUBLE)" for c, w in EXTERNAL_WEIGHTS.items())
    + " + CAST(-0.5 AS DOUBLE)))), 6) AS p FROM features"
)
def score_external(spark, sf):
    scored = external_scorer(_load_external, _predict_external)(fx.features(spark, sf))
    return scored.select("row_id", F.round("p", 6).alias("p"))
