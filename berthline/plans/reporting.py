"""Report bundles over ledgers and placement runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from berthline.operators import ledger as ld
from berthline.operators import reports as rp
from berthline.operators.occupancy import BUCKET_MS, utilization_timeline
from berthline.session import store


def ledger_report(allocations: DataFrame, machines: DataFrame, bucket_ms: int = BUCKET_MS) -> dict[str, DataFrame]:
    """Cost and energy, the utilisation timeline (wide and long) and the latest sample per machine.

    The timeline is stored, as three of the frames read it.
    """
    timeline = store(utilization_timeline(allocations, machines, bucket_ms), "timeline")
    return {
        "machine_ledger": ld.machine_ledger(allocations, machines),
        "utilization_timeline": timeline,
        "utilization_long": ld.unpivot_utilization(timeline, ["machine_id", "time_ms"]),
        "latest_sample": ld.latest_sample(timeline.drop("until_ms")),
    }


def run_report(placements: DataFrame, machine_ledger: DataFrame) -> dict[str, DataFrame]:
    """All report frames of one placement run."""
    return {
        "run_kpis": rp.run_kpis(placements, machine_ledger),
        "model_comparison": rp.model_comparison(placements),
        "task_distribution": rp.task_distribution(placements),
        "risk_summary": rp.risk_summary(placements),
        "sla_histogram": rp.sla_histogram(rp.scheduled_only(placements)),
        "sla_box_stats": rp.sla_box_stats(placements),
        "energy_fit_density": rp.energy_fit_density(placements),
        "recent_log": rp.recent_log(placements),
    }
