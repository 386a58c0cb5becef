"""SQL text of the derived tables, for the check against another engine."""

from __future__ import annotations

from berthline.schemas import PRESET_SCHEMA, PRESETS


def epoch(name: str) -> str:
    return f"(epoch_us({name}) // 1000)"


_PRESET_ROWS = ", ".join(
    f"({idx}, '{name}', " + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + ")" for idx, name, *values in PRESETS
)
PRESETS_CTE = f"presets({', '.join(PRESET_SCHEMA.fieldNames())}) AS (VALUES {_PRESET_ROWS})"

MACHINES_CTE = PRESETS_CTE + """, machines0 AS (
  SELECT s_suppkey AS machine_id, s_name AS machine_name, p.* EXCLUDE (preset_idx, preset),
    CAST(s_suppkey % 4 AS DOUBLE) AS cpu_cores_used,
    CAST(CASE WHEN p.gpu_cores_total > 0 THEN (s_suppkey % 5) * 128 ELSE 0 END AS DOUBLE) AS gpu_cores_used,
    CAST(CASE WHEN p.gpu_vram_total_gb > 0 THEN s_suppkey % 3 ELSE 0 END AS DOUBLE) AS gpu_vram_used_gb,
    CAST(s_suppkey % 7 AS DOUBLE) AS ram_used_gb
  FROM supplier JOIN presets p ON p.preset_idx = s_suppkey % 5
), machines AS (
  SELECT *, cpu_watts * cpu_cores_used / cpu_cores_total AS current_cpu_power_w,
    gpu_watts * gpu_cores_used / greatest(1, gpu_cores_total) AS current_gpu_power_w
  FROM machines0
)"""


def requests(key: str) -> str:
    return f"""CAST(1 + {key} % 8 AS DOUBLE) AS req_cpu_cores,
    CAST(CASE WHEN {key} % 3 = 0 THEN ({key} * 37) % 513 ELSE 0 END AS DOUBLE) AS req_gpu_cores,
    CAST(CASE WHEN {key} % 3 = 0 THEN {key} % 16 ELSE 0 END AS DOUBLE) AS req_gpu_vram_gb,
    CAST(2 + ({key} * 5) % 15 AS DOUBLE) AS req_ram_gb"""


TASKS_CTE = f"""tasks AS (
  SELECT o_orderkey AS task_id, {epoch('o_orderdate')} AS arrival_ms, {requests('o_orderkey')},
    CAST(5 AS DOUBLE) + CAST((o_orderkey * 13) % 5501 AS DOUBLE) / CAST(100 AS DOUBLE) AS execution_time
  FROM orders
)"""

FRACTIONAL_TASKS_CTE = """tasks AS (
  SELECT o_orderkey AS task_id, CAST(0.25 AS DOUBLE) + CAST(7 AS DOUBLE) * u AS req_cpu_cores,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(500 AS DOUBLE) * v ELSE CAST(0 AS DOUBLE) END AS req_gpu_cores,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(15 AS DOUBLE) * u ELSE CAST(0 AS DOUBLE) END AS req_gpu_vram_gb,
    CAST(0.5 AS DOUBLE) + CAST(20 AS DOUBLE) * v AS req_ram_gb
  FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / CAST(1000 AS DOUBLE) - floor(CAST(o_totalprice AS DOUBLE) / CAST(1000 AS DOUBLE)) AS u,
    CAST(o_totalprice AS DOUBLE) / CAST(7 AS DOUBLE) - floor(CAST(o_totalprice AS DOUBLE) / CAST(7 AS DOUBLE)) AS v FROM orders) x
)"""

ALLOCATIONS_CTE = f"""allocations AS (
  SELECT l_orderkey AS task_id, l_suppkey AS machine_id, {epoch('l_shipdate')} AS start_ms,
    {epoch('l_shipdate')} + CAST(l_quantity * 3600000 AS BIGINT) AS finish_ms, {requests('l_orderkey')}
  FROM lineitem
)"""

SCORED_CTE = """scored0 AS (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y,
    'm' || CAST(o_orderkey % 3 AS VARCHAR) AS model_used FROM orders
), scored AS (
  SELECT row_id, y, CAST((row_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.5 AS DOUBLE)
    + CAST(0.4 AS DOUBLE) * y + CAST(0.05 AS DOUBLE) AS p, model_used FROM scored0
)"""

PLACEMENTS_CTE = SCORED_CTE + """, placements0 AS (
  SELECT row_id AS task_id, model_used, p, CASE WHEN row_id % 10 = 0 THEN 'no_free_machine'
    WHEN row_id % 10 = 1 THEN 'no_suitable_free_machine'
    WHEN p >= CAST(0.8 AS DOUBLE) THEN 'all_predict_violation' ELSE 'scheduled' END AS status FROM scored
), placements AS (
  SELECT task_id, status, model_used,
    CASE WHEN status = 'scheduled' THEN (task_id * 31) % (SELECT count(*) FROM supplier) END AS machine_id,
    CASE WHEN status = 'scheduled' THEN p END AS sla_probability,
    CASE WHEN status = 'scheduled' THEN CAST((task_id * 17) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS energy_score,
    CASE WHEN status = 'scheduled' THEN CAST((task_id * 29) % 97 AS DOUBLE) / CAST(96 AS DOUBLE) END AS fit_score
  FROM placements0
)"""

LEDGER_CTE = """ledger AS (
  SELECT m.machine_id, m.machine_name, count(a.task_id) AS n_tasks,
    coalesce(sum((a.finish_ms - a.start_ms) / CAST(3600000 AS DOUBLE)), 0) AS busy_hours,
    coalesce(sum((a.finish_ms - a.start_ms) / CAST(3600000 AS DOUBLE) * m.cost_per_hour), 0) AS total_cost,
    coalesce(sum((a.finish_ms - a.start_ms) / CAST(3600000 AS DOUBLE) *
      (a.req_cpu_cores / m.cpu_cores_total * m.cpu_watts
       + a.req_gpu_cores / greatest(1, m.gpu_cores_total) * m.gpu_watts)), 0) AS energy_wh
  FROM machines m LEFT JOIN allocations a ON a.machine_id = m.machine_id GROUP BY m.machine_id, m.machine_name
)"""

FEATURES_CTE = MACHINES_CTE + ", " + TASKS_CTE + """, features0 AS (
  SELECT t.task_id AS row_id, m.cpu_cores_total, m.cpu_watts, m.gpu_cores_total, m.gpu_vram_total_gb, m.gpu_watts,
    m.ram_total_gb, m.cpu_cores_used, m.gpu_cores_used, m.gpu_vram_used_gb, m.ram_used_gb, m.current_cpu_power_w,
    m.current_gpu_power_w, t.req_cpu_cores, t.req_gpu_cores, t.req_gpu_vram_gb, t.req_ram_gb
  FROM tasks t JOIN machines m ON m.machine_id = t.task_id % (SELECT count(*) FROM supplier)
), features AS (
  SELECT *, CASE WHEN """ + " OR ".join(
    f"({t} - {u} <= 0 AND {r} > 0) OR ({t} - {u} > 0 AND {r} > CAST(0.8 AS DOUBLE) * ({t} - {u}))"
    for t, u, r in (
        ("cpu_cores_total", "cpu_cores_used", "req_cpu_cores"),
        ("gpu_cores_total", "gpu_cores_used", "req_gpu_cores"),
        ("gpu_vram_total_gb", "gpu_vram_used_gb", "req_gpu_vram_gb"),
        ("ram_total_gb", "ram_used_gb", "req_ram_gb"),
    )
) + """ THEN 1 ELSE 0 END AS sla_violation FROM features0
)"""


def ranked(alpha: float, profile: str, k: int, overrides: dict[str, float] | None = None) -> str:
    """All pairs, scored and ranked the plain way."""
    o = overrides or {}
    left = {
        "cpu": ("cpu_cores_total", "cpu_cores_used", "req_cpu_cores"),
        "gpu": ("gpu_cores_total", "gpu_cores_used", "req_gpu_cores"),
        "vram": ("gpu_vram_total_gb", "gpu_vram_used_gb", "req_gpu_vram_gb"),
        "ram": ("ram_total_gb", "ram_used_gb", "req_ram_gb"),
    }
    d = "CAST({} AS DOUBLE)".format
    fits = " AND ".join(f"m.{t} - m.{u} + {d('1e-9')} >= t.{r}" for t, u, r in left.values())
    fit = " + ".join(f"abs(m.{t} - m.{u} - t.{r}) / greatest(m.{t}, {d('1e-9')})" for t, u, r in left.values())
    if profile == "floored":
        unit = {
            "cpu": "greatest(1, cpu_watts / greatest(cpu_cores_total, 1))",
            "gpu": f"CASE WHEN gpu_cores_total > 0 THEN greatest({d('0.1')}, gpu_watts / greatest(gpu_cores_total, 1))"
            " ELSE 0 END",
            "vram": f"CASE WHEN gpu_vram_total_gb > 0 THEN greatest({d('0.5')}, gpu_watts / "
            "greatest(gpu_vram_total_gb, 1)) ELSE 0 END",
            "ram": d("0.5"),
        }
    else:
        unit = {
            "cpu": f"cpu_watts / greatest(cpu_cores_total, {d('1e-9')})",
            "gpu": f"gpu_watts / greatest(gpu_cores_total, {d('1e-9')})",
            "vram": f"gpu_watts / greatest(gpu_vram_total_gb, {d('1e-9')})",
            "ram": f"greatest({d('0.05')}, least({d('2.0')}, (current_cpu_power_w + current_gpu_power_w) * {d('0.02')}"
            " / greatest(ram_total_gb, 1)))",
        }
    unit.update({r: d(v) for r, v in o.items()})
    watts = " + ".join(f"({unit[r]}) * t.{left[r][2]}" for r in left)
    if profile == "floored":
        watts = f"greatest({d('0.1')}, {watts})"
        fit_flat, energy_flat, limit = "fit_raw", "CASE WHEN wmax > 0 THEN watts / wmax ELSE 0 END", "0.01"
    else:
        fit_flat, energy_flat, limit = "0", "0", "1e-9"
    return f"""pairs AS (
  SELECT t.task_id, m.machine_id, ({fit}) / 4 AS fit_raw, {watts} AS watts
  FROM tasks t JOIN machines m ON {fits}
), bounds AS (
  SELECT *, min(fit_raw) OVER w AS fmin, max(fit_raw) OVER w AS fmax, min(watts) OVER w AS wmin, max(watts) OVER w AS wmax
  FROM pairs WINDOW w AS (PARTITION BY task_id)
), normed AS (
  SELECT task_id, machine_id, watts, fit_raw,
    CASE WHEN wmax - wmin < {d(limit)} THEN {energy_flat} ELSE (watts - wmin) / (wmax - wmin) END AS energy_score,
    CASE WHEN fmax - fmin < {d('1e-9')} THEN {fit_flat} ELSE (fit_raw - fmin) / (fmax - fmin) END AS fit_score
  FROM bounds
), finals AS (
  SELECT *, {d(alpha)} * energy_score + {d(1.0 - alpha)} * fit_score AS final_score FROM normed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY floor(final_score * 1e9 + 0.5), floor(watts * 1e9 + 0.5),
    floor(fit_score * 1e9 + 0.5), machine_id) AS rank FROM finals
), top AS (SELECT * FROM ranked WHERE rank <= {k})"""
