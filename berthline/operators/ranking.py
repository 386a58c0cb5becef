"""Ranking of capable machines by weighted energy and fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.functions import scoring
from berthline.operators.candidates import capable_pairs, fill_requests, machine_classes, machine_states, request_shapes
from berthline.operators.pruning import pruned_pairs, surviving_classes
from berthline.operators.skew import salted_join
from berthline.schemas import MACHINE_COLUMNS, REMAINING, REQUEST_COLUMNS
from berthline.session import store

#: Pairs of request shapes and machine classes from which it pays to decide for boxes of requests first.
PRUNE_FROM = 1 << 27
#: Fewer shapes than this make too few boxes for it, however many classes there are.
PRUNE_SHAPES = 1 << 12

SCORE_COLUMNS = ["watts", "fit_raw", "energy_score", "fit_score", "final_score"]


def with_raw_scores(
    pairs: DataFrame, profile: str = "floored", overrides: scoring.PowerOverrides = scoring.PowerOverrides()
) -> DataFrame:
    return pairs.withColumns({"fit_raw": scoring.raw_fit(), "watts": scoring.incremental_watts(profile, overrides)})


def candidate_extrema(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest and largest fit and watts among the candidates of each request."""
    return pairs.groupBy(*keys).agg(
        F.min("fit_raw").alias("fit_min"),
        F.max("fit_raw").alias("fit_max"),
        F.min("watts").alias("watts_min"),
        F.max("watts").alias("watts_max"),
    )


def with_scores(pairs: DataFrame, alpha: float = 0.5, profile: str = "floored") -> DataFrame:
    """Normalised energy and fit and their weighted sum; needs the extrema columns."""
    return (
        pairs.withColumns({"energy_score": scoring.energy_score(profile), "fit_score": scoring.fit_score(profile)})
        .withColumn("final_score", scoring.final_score(alpha))
        .drop("fit_min", "fit_max", "watts_min", "watts_max")
    )


def score_order(tie_break: str) -> list:
    """Best first; scores that differ only by rounding noise fall to the smaller id."""
    return [_ninth_decimal(c) for c in ("final_score", "watts", "fit_score")] + [F.col(tie_break)]


def _ninth_decimal(c: str) -> Column:
    """A value in units of 1e-9, by plain arithmetic (``round`` on doubles goes through decimals)."""
    return F.floor(F.col(c) * F.lit(1e9) + F.lit(0.5))


def class_members(machines: DataFrame, k: int, power: bool = True) -> DataFrame:
    """The k smallest machine ids of every class, next to the class id."""
    filled = machine_states(machines, power)
    same = W.partitionBy(*MACHINE_COLUMNS)
    return (
        filled.select(*MACHINE_COLUMNS, "machine_id", F.row_number().over(same.orderBy("machine_id")).alias("_nth"))
        .filter(F.col("_nth") <= k)
        .select(F.min("machine_id").over(same).alias("class_id"), "machine_id")
    )


def scored_candidates(
    shapes: DataFrame, classes: DataFrame, alpha: float = 0.5, profile: str = "floored",
    overrides: scoring.PowerOverrides = scoring.PowerOverrides(), k: int = 1, prune: bool | None = None,
) -> DataFrame:
    """Request shapes with the classes that can be among their k best, scored against all their candidates.

    The candidate pairs are never shuffled: one pass reduces them to four extrema per shape, a
    second one scores them. ``prune`` first leaves out the classes that matter to no request of
    a box of requests (exact; see ``pruning``); unless given, it depends on the number of pairs.
    """
    shapes = shapes.select(*REQUEST_COLUMNS)
    if prune is None:
        n = shapes.count()
        prune = n >= PRUNE_SHAPES and n * classes.count() >= PRUNE_FROM
    if prune:
        classes = store(classes, "machine-classes")
        shapes, classes = surviving_classes(shapes, classes, alpha, profile, overrides, k)
    pairs, keys = (pruned_pairs, [*REQUEST_COLUMNS, "_cell"]) if prune else (capable_pairs, REQUEST_COLUMNS)
    extrema = candidate_extrema(with_raw_scores(pairs(shapes, classes), profile, overrides), keys)
    return with_scores(with_raw_scores(pairs(extrema, classes), profile, overrides), alpha, profile)


def rank_shapes(
    shapes: DataFrame, machines: DataFrame, alpha: float = 0.5, profile: str = "floored",
    overrides: scoring.PowerOverrides = scoring.PowerOverrides(), k: int = 1, prune: bool | None = None,
) -> DataFrame:
    """The k best machines of every request shape.

    k classes per shape are kept before the exchange. A class can only hold one of the k best
    machines if its smallest id is among the k best smallest ids, so members are listed for
    those classes alone.
    """
    scoring.check_alpha(alpha)
    scoring.check_profile(profile)
    if k < 1:
        raise ValueError("k must be at least 1")
    power = scoring.reads_current_power(profile, overrides)
    scored = scored_candidates(shapes, machine_classes(machines, power), alpha, profile, overrides, k, prune)
    per_shape = W.partitionBy(*REQUEST_COLUMNS)
    best = scored.withColumn("rank", F.row_number().over(per_shape.orderBy(*score_order("class_id")))).filter(
        F.col("rank") <= k
    )
    if k == 1:
        best = best.withColumn("machine_id", F.col("class_id"))
    else:
        listed = best.drop("rank").join(class_members(machines, k, power), "class_id")
        best = listed.withColumn("rank", F.row_number().over(per_shape.orderBy(*score_order("machine_id")))).filter(
            F.col("rank") <= k
        )
    return best.select(*REQUEST_COLUMNS, "rank", "machine_id", *REMAINING.values(), *SCORE_COLUMNS)


def rank_placements(
    tasks: DataFrame, machines: DataFrame, alpha: float = 0.5, profile: str = "floored",
    overrides: scoring.PowerOverrides = scoring.PowerOverrides(), k: int = 1, prune: bool | None = None,
) -> DataFrame:
    """The k best machines of every task against one snapshot of the fleet."""
    best = rank_shapes(request_shapes(tasks), machines, alpha, profile, overrides, k, prune)
    return salted_join(fill_requests(tasks), best, REQUEST_COLUMNS, ["task_id"])


def winner_lookup(placements: DataFrame, machines: DataFrame, columns: list[str]) -> DataFrame:
    """Attach attributes of the chosen machine."""
    return placements.join(machines.select("machine_id", *columns), "machine_id", "left")
