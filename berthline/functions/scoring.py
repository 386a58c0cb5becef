"""Fit, power and final-score expressions of the ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from berthline.schemas import REMAINING, REQUESTS, RESOURCES, TOTALS

# Fixed values of the two scoring profiles.
EPS = 1e-9
FLAT_FIT = 1e-9
FLAT_WATTS = {"floored": 0.01, "plain": 1e-9}
CPU_FLOOR_W = 1.0
GPU_FLOOR_W = 0.1
VRAM_FLOOR_W = 0.5
RAM_DEFAULT_W = 0.5
TOTAL_FLOOR_W = 0.1
RAM_SHARE = 0.02
RAM_CLAMP_W = (0.05, 2.0)
PROFILES = ("floored", "plain")


@dataclass(frozen=True)
class PowerOverrides:
    """Per-unit watts that replace the values derived from a machine's totals."""

    cpu_power_per_core: float | None = None
    gpu_power_per_core: float | None = None
    gpu_vram_power_per_gb: float | None = None
    ram_power_per_gb: float | None = None


def check_profile(profile: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    return profile


def check_alpha(alpha: float) -> float:
    if not 0.0 <= float(alpha) <= 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    return float(alpha)


# The expressions are written as SQL text: each becomes one call to the JVM instead of dozens.


def number(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def fits(eps: float = EPS) -> Column:
    """Remaining capacity covers the request on all four resources."""
    return F.expr(" AND ".join(f"{REMAINING[r]} + {number(eps)} >= {REQUESTS[r]}" for r in RESOURCES))


def raw_fit() -> Column:
    """Mean leftover share of a machine's totals once the request is in place."""
    shares = (f"abs({REMAINING[r]} - {REQUESTS[r]}) / greatest({TOTALS[r]}, {number(EPS)})" for r in RESOURCES)
    return F.expr(f"({' + '.join(shares)}) / 4.0D")


def _derived_floored() -> dict[str, str]:
    def unit(watts: str, total: str, floor: float) -> str:
        return f"greatest({number(floor)}, {watts} / greatest({total}, 1.0D))"

    def unit_if_any(watts: str, total: str, floor: float) -> str:
        return f"CASE WHEN {total} > 0 THEN {unit(watts, total, floor)} ELSE 0.0D END"

    return {
        "cpu": unit("cpu_watts", TOTALS["cpu"], CPU_FLOOR_W),
        "gpu": unit_if_any("gpu_watts", TOTALS["gpu"], GPU_FLOOR_W),
        "vram": unit_if_any("gpu_watts", TOTALS["vram"], VRAM_FLOOR_W),
        "ram": number(RAM_DEFAULT_W),
    }


def _derived_plain() -> dict[str, str]:
    low, high = (number(v) for v in RAM_CLAMP_W)
    draw = "coalesce(current_cpu_power_w, 0.0D) + coalesce(current_gpu_power_w, 0.0D)"
    per_gb = f"({draw}) * {number(RAM_SHARE)} / greatest({TOTALS['ram']}, 1.0D)"
    return {
        "cpu": f"cpu_watts / greatest({TOTALS['cpu']}, {number(EPS)})",
        "gpu": f"gpu_watts / greatest({TOTALS['gpu']}, {number(EPS)})",
        "vram": f"gpu_watts / greatest({TOTALS['vram']}, {number(EPS)})",
        "ram": f"greatest({low}, least({high}, {per_gb}))",
    }


def reads_current_power(profile: str, overrides: PowerOverrides = PowerOverrides()) -> bool:
    """Whether the estimate depends on a machine's current draw."""
    return check_profile(profile) == "plain" and overrides.ram_power_per_gb is None


def unit_watts(profile: str = "floored", overrides: PowerOverrides = PowerOverrides()) -> dict[str, str]:
    """Watts that one requested unit of each resource adds on a machine, as SQL."""
    per_unit = _derived_floored() if check_profile(profile) == "floored" else _derived_plain()
    given = {
        "cpu": overrides.cpu_power_per_core,
        "gpu": overrides.gpu_power_per_core,
        "vram": overrides.gpu_vram_power_per_gb,
        "ram": overrides.ram_power_per_gb,
    }
    per_unit.update({r: number(v) for r, v in given.items() if v is not None})
    return per_unit


def incremental_watts(profile: str = "floored", overrides: PowerOverrides = PowerOverrides()) -> Column:
    """Estimated extra draw of a machine that takes the request."""
    per_unit = unit_watts(profile, overrides)
    watts = " + ".join(f"({per_unit[r]}) * {REQUESTS[r]}" for r in RESOURCES)
    return F.expr(f"greatest({number(TOTAL_FLOOR_W)}, {watts})" if profile == "floored" else watts)


def fit_score(profile: str = "floored") -> Column:
    """Min-max over the request's candidates, from columns fit_raw, fit_min and fit_max."""
    flat = "fit_raw" if check_profile(profile) == "floored" else "0.0D"
    return F.expr(
        f"CASE WHEN fit_max - fit_min < {number(FLAT_FIT)} THEN {flat} "
        "ELSE try_divide(fit_raw - fit_min, fit_max - fit_min) END"
    )


def energy_score(profile: str = "floored") -> Column:
    """Min-max over the request's candidates, from columns watts, watts_min and watts_max."""
    flat = "0.0D"
    if check_profile(profile) == "floored":
        flat = "CASE WHEN watts_max > 0 THEN try_divide(watts, watts_max) ELSE 0.0D END"
    return F.expr(
        f"CASE WHEN watts_max - watts_min < {number(FLAT_WATTS[profile])} THEN {flat} "
        "ELSE try_divide(watts - watts_min, watts_max - watts_min) END"
    )


def final_score(alpha: float) -> Column:
    """Weighted energy and fit, from columns energy_score and fit_score; lower is better."""
    a = check_alpha(alpha)
    return F.expr(f"{number(a)} * energy_score + {number(1.0 - a)} * fit_score")
