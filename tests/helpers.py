"""Small fixtures and plain-Python versions of the operators to compare with."""

import random

from berthline.schemas import MACHINE_COLUMNS, PRESETS, REQUEST_COLUMNS, SPEC_COLUMNS


def machine(machine_id, preset=0, used=(0, 0, 0, 0), power=(0.0, 0.0), **spec):
    values = dict(zip(SPEC_COLUMNS, PRESETS[preset][2:])) | spec
    usage = dict(zip(("cpu_cores_used", "gpu_cores_used", "gpu_vram_used_gb", "ram_used_gb"), map(float, used)))
    return {
        "machine_id": machine_id, "machine_name": f"m{machine_id}", **values, **usage,
        "current_cpu_power_w": power[0], "current_gpu_power_w": power[1],
    }


def fleet(spark, machines):
    columns = ["machine_id", "machine_name", *SPEC_COLUMNS, *[c for c in MACHINE_COLUMNS if c not in SPEC_COLUMNS]]
    return spark.createDataFrame([tuple(m[c] for c in columns) for m in machines],
                                 "machine_id long, machine_name string, " + ", ".join(f"{c} double" for c in columns[2:]))


def task(task_id, cpu=1, gpu=0, vram=0, ram=1, arrival_ms=0, seconds=10.0):
    return (task_id, arrival_ms, float(cpu), float(gpu), float(vram), float(ram), float(seconds))


def workload(spark, rows):
    return spark.createDataFrame(
        rows, "task_id long, arrival_ms long, " + ", ".join(f"{c} double" for c in REQUEST_COLUMNS) + ", execution_time double"
    )


def ledger(spark, rows):
    """(task_id, machine_id, start_ms, finish_ms, cpu, gpu, vram, ram)"""
    return spark.createDataFrame(
        rows, "task_id long, machine_id long, start_ms long, finish_ms long, "
        + ", ".join(f"{c} double" for c in REQUEST_COLUMNS)
    )


def random_ledger(seed, n, machines, horizon_s):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(horizon_s) * 1000
        length = rng.choice([0, 1, 1500, rng.randrange(horizon_s * 200)])
        # a third of all rows belongs to machine 1
        m = 1 if rng.random() < 1 / 3 else rng.randrange(machines)
        rows.append((i, m, start, start + length, float(rng.randrange(1, 5)), 0.0, 0.0, float(rng.randrange(1, 9))))
    return rows


def brute_rank(machines, request, alpha=0.5, profile="floored", overrides=None):
    """Candidates of one request, best first, scored one by one."""
    over = overrides or {}
    dims = [("cpu_cores", 0), ("gpu_cores", 1), ("gpu_vram", 2), ("ram", 3)]
    total = ["cpu_cores_total", "gpu_cores_total", "gpu_vram_total_gb", "ram_total_gb"]
    used = ["cpu_cores_used", "gpu_cores_used", "gpu_vram_used_gb", "ram_used_gb"]
    found = []
    for m in machines:
        left = [m[t] - m[u] for t, u in zip(total, used)]
        if any(left[i] + 1e-9 < request[i] for _, i in dims):
            continue
        fit = sum(abs(left[i] - request[i]) / max(m[total[i]], 1e-9) for i in range(4)) / 4
        if profile == "floored":
            unit = [
                max(1.0, m["cpu_watts"] / max(m[total[0]], 1)),
                max(0.1, m["gpu_watts"] / max(m[total[1]], 1)) if m[total[1]] > 0 else 0.0,
                max(0.5, m["gpu_watts"] / max(m[total[2]], 1)) if m[total[2]] > 0 else 0.0,
                0.5,
            ]
        else:
            draw = m["current_cpu_power_w"] + m["current_gpu_power_w"]
            unit = [
                m["cpu_watts"] / max(m[total[0]], 1e-9), m["gpu_watts"] / max(m[total[1]], 1e-9),
                m["gpu_watts"] / max(m[total[2]], 1e-9), max(0.05, min(2.0, draw * 0.02 / max(m[total[3]], 1.0))),
            ]
        unit = [over.get(i, u) for i, u in enumerate(unit)]
        watts = sum(u * r for u, r in zip(unit, request))
        found.append((m["machine_id"], fit, max(0.1, watts) if profile == "floored" else watts))
    if not found:
        return []
    fits, powers = [f for _, f, _ in found], [w for _, _, w in found]
    fit_span, watt_span = max(fits) - min(fits), max(powers) - min(powers)
    out = []
    for mid, fit, watts in found:
        if fit_span < 1e-9:
            fs = fit if profile == "floored" else 0.0
        else:
            fs = (fit - min(fits)) / fit_span
        if watt_span < (0.01 if profile == "floored" else 1e-9):
            es = watts / max(powers) if profile == "floored" and max(powers) > 0 else 0.0
        else:
            es = (watts - min(powers)) / watt_span
        out.append((round(alpha * es + (1 - alpha) * fs, 9), round(watts, 9), round(fs, 9), mid, es))
    return sorted(out)
