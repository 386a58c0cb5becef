"""Report frames over placements, fleets and workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.functions.numeric import numeric_or_null, ratio
from berthline.operators.skew import free_nulls, hold_nulls, running_totals, salted_join, score_buckets
from berthline.schemas import SCHEDULED
from berthline.session import store

HISTOGRAM_BINS = 20
HIGH_RISK = 0.5


def scheduled_only(placements: DataFrame) -> DataFrame:
    return placements.filter(F.col("status") == SCHEDULED)


def drop_non_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, without rows in which any of them is not a number."""
    typed = df.withColumns({c: numeric_or_null(c) for c in columns})
    return typed.dropna(subset=list(columns))


def high_risk(df: DataFrame, p: str = "sla_probability", limit: float = HIGH_RISK) -> DataFrame:
    return df.filter(F.col(p) > limit)


def fleet_kpis(snapshot: DataFrame, placements: DataFrame) -> DataFrame:
    """Machines, busy machines, scheduled tasks, booked energy."""
    scheduled = placements.agg(F.count_if(F.col("status") == SCHEDULED)).scalar()
    return snapshot.agg(
        F.count(F.lit(1)).alias("n_machines"),
        F.count_if(F.col("active_tasks") > 0).alias("n_busy"),
        F.coalesce(F.sum("energy_wh"), F.lit(0.0)).alias("energy_wh"),
    ).select("n_machines", "n_busy", scheduled.alias("n_scheduled"), "energy_wh")


def run_kpis(placements: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tasks processed and failed, success rate in percent, total cost and energy."""
    cost = ledger.agg(F.coalesce(F.sum("total_cost"), F.lit(0.0))).scalar()
    energy = ledger.agg(F.coalesce(F.sum("energy_wh"), F.lit(0.0))).scalar()
    return placements.agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("status") == SCHEDULED).alias("n_scheduled")
    ).select(
        "n_tasks",
        "n_scheduled",
        (F.col("n_tasks") - F.col("n_scheduled")).alias("n_failed"),
        (ratio(F.col("n_scheduled"), F.col("n_tasks")) * 100).alias("success_rate"),
        cost.alias("total_cost"),
        energy.alias("energy_wh"),
    )


def model_comparison(placements: DataFrame) -> DataFrame:
    """Scheduled tasks, all tasks and success rate per model."""
    return placements.groupBy("model_used").agg(
        F.count_if(F.col("status") == SCHEDULED).alias("n_scheduled"), F.count(F.lit(1)).alias("n_tasks")
    ).withColumn("success_rate", ratio(F.col("n_scheduled"), F.col("n_tasks")) * 100)


def task_distribution(placements: DataFrame) -> DataFrame:
    """Scheduled tasks per machine with their share of all, largest first."""
    scheduled = scheduled_only(placements)
    total = scheduled.agg(F.count(F.lit(1))).scalar()
    return (
        scheduled.groupBy("machine_id")
        .agg(F.count(F.lit(1)).alias("n_tasks"))
        .withColumn("share_pct", ratio(F.col("n_tasks"), total) * 100)
        .orderBy(F.desc("n_tasks"), "machine_id")
    )


def risk_summary(placements: DataFrame) -> DataFrame:
    """Mean risk, number above 0.5, mean energy and fit score of scheduled tasks."""
    return scheduled_only(placements).agg(
        F.avg("sla_probability").alias("avg_sla"),
        F.count_if(F.col("sla_probability") > HIGH_RISK).alias("n_high_risk"),
        F.avg("energy_score").alias("avg_energy_score"),
        F.avg("fit_score").alias("avg_fit_score"),
    )


def sla_histogram(placements: DataFrame, bins: int = HISTOGRAM_BINS, p: str = "sla_probability") -> DataFrame:
    """Counts in equal bins over [0, 1]; 1.0 falls in the last bin and empty bins show 0."""
    value = F.col(p)
    index = F.least(F.greatest(F.floor(value * F.lit(bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = placements.filter(value.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = placements.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key of values in [0, 1].

    Equal values are counted first; running counts then show which value sits at the wanted
    ranks, so no task ever holds a key's whole distribution.
    """
    held = hold_nulls(df, keys).filter(F.col(value).isNotNull())
    counted = held.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return free_nulls(_quantiles_of(store(counted, "value-counts"), keys, value, at), keys)


def _quantiles_of(counted: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Quantiles from a stored table of how often (_n) each value occurs."""
    upto = running_totals(counted, keys, value, {"_upto": "_n"}, score_buckets(F.col(value)))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = salted_join(upto, sizes, keys, [value])

    def at_rank(rank):
        hit = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(hit, F.col(value)))

    ends = []
    for name, q in at.items():
        h = (F.col("_size") - 1) * F.lit(q)
        ends += [at_rank(F.floor(h)).alias(f"_lo_{name}"), at_rank(F.ceil(h)).alias(f"_hi_{name}")]
    found = ranked.groupBy(*keys).agg(F.max("_size").alias("n"), *ends)

    def between(name: str, q: float):
        h = (F.col("n") - 1) * F.lit(q)
        return F.col(f"_lo_{name}") + (h - F.floor(h)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))

    return found.select(*keys, "n", *[between(name, q).alias(name) for name, q in at.items()])


def sla_box_stats(placements: DataFrame, p: str = "sla_probability") -> DataFrame:
    """Per model: extremes, quartiles and the whisker fences (last values within 1.5 IQR).

    A null model is one of its own; rows without a probability are left out.
    """
    keys = ["model_used"]
    scheduled = scheduled_only(placements).select("model_used", F.col(p).alias("p")).filter("p IS NOT NULL")
    counted = store(hold_nulls(scheduled, keys).groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    quartiles = store(_quantiles_of(counted, keys, "p", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "quartiles")
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("p").between(F.col("q1") - reach, F.col("q3") + reach), F.col("p"))
    ends = (
        salted_join(counted, quartiles.drop("n"), keys, ["p"])
        .groupBy(*keys)
        .agg(
            F.min("p").alias("p_min"), F.max("p").alias("p_max"),
            F.min(inside).alias("fence_low"), F.max(inside).alias("fence_high"),
        )
    )
    return free_nulls(quartiles.join(ends, keys), keys)


def energy_vs_fit(placements: DataFrame) -> DataFrame:
    """(energy, fit) of every scheduled task."""
    return drop_non_numeric(
        scheduled_only(placements).select("task_id", "energy_score", "fit_score"), ["energy_score", "fit_score"]
    )


def energy_fit_density(placements: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The scatter as a grid of counts, for volumes that no chart can show point by point."""
    def cell(c: str):
        return F.least(F.greatest(F.floor(F.col(c) * F.lit(bins)), F.lit(0)), F.lit(bins - 1)).cast("int")

    return (
        energy_vs_fit(placements)
        .groupBy(cell("energy_score").alias("energy_bin"), cell("fit_score").alias("fit_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def recent_log(placements: DataFrame, n: int = 10, order: str = "task_id") -> DataFrame:
    """The last n results, oldest first."""
    return placements.orderBy(F.desc(order)).limit(n).orderBy(order)


def format_scores(df: DataFrame, columns: list[str], decimals: int = 3) -> DataFrame:
    """Scores rounded for display, still numbers."""
    return df.withColumns({c: F.round(c, decimals) for c in columns})
