"""Placement of tasks against the ledger state at their arrival."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.functions import scoring
from berthline.functions.numeric import coalesce_zero
from berthline.operators.candidates import assemble_features, capable_pairs, fill_requests, machine_classes
from berthline.operators.occupancy import first_members, free_by_class, free_members, idle_spans
from berthline.operators.ranking import score_order, with_raw_scores, with_scores
from berthline.operators.skew import integer_bucket, ordered_rank, salted_join
from berthline.schemas import (
    ALL_VIOLATE, FAILED, MACHINE_COLUMNS, NO_ARRIVAL, NO_FREE, NO_SUITABLE, REQUEST_COLUMNS, SCHEDULED, SCORE_ERROR,
    SPEC_COLUMNS,
)
from berthline.session import cut_lineage, never_broadcast, store

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PlacementRules:
    """How a placement run decides."""

    alpha: float = 0.5
    tau: float = 0.5
    profile: str = "floored"
    overrides: scoring.PowerOverrides = scoring.PowerOverrides()
    model_used: str = "model"
    constant_power: bool = True
    quantum_ms: int = 1000
    cover_bits: int | None = None
    bucket_ms: int = 86_400_000


def _idle_classes(machines: DataFrame, allocations: DataFrame, rules: PlacementRules) -> tuple[DataFrame, DataFrame]:
    """(classes, spans): machine specs, and when each machine is idle, by class.

    Only a machine without active tasks takes a task, so a class is a spec and its members
    differ in nothing but their idle times.
    """
    specs = machines.select("machine_id", *[coalesce_zero(c).alias(c) for c in SPEC_COLUMNS if c != "cost_per_hour"])
    idle = specs.withColumns({c: F.lit(0.0) for c in MACHINE_COLUMNS if c not in specs.columns})
    classes = machine_classes(idle)
    members = idle.join(classes.select(*MACHINE_COLUMNS, "class_id"), MACHINE_COLUMNS).select("machine_id", "class_id")
    spans = idle_spans(allocations, machines, rules.bucket_ms)
    return classes, salted_join(never_broadcast(spans), members, ["machine_id"], ["from_ms"])


def class_candidates(
    tasks: DataFrame, machines: DataFrame, allocations: DataFrame, scorer: Scorer, rules: PlacementRules,
    idle: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, free, asked): per distinct (arrival, request) the classes with a free machine that can
    hold it, per arrival the free machines of every class, and the distinct (arrival, request) rows.
    The latter two are stored, as several branches of a placement read them.

    Carries the class's free count and smallest free id, its violation probability ``p``
    and raw scores. Feasibility, the model and the power estimate see each (request, class)
    pair once, whatever the number of tasks; the model runs after the feasibility test. The
    scorer adds ``p`` and keeps the other columns. ``idle`` gives the classes and idle spans where
    they are known already.
    """
    scoring.check_alpha(rules.alpha)
    classes, spans = idle or _idle_classes(machines, allocations, rules)
    asked = never_broadcast(store(fill_requests(tasks).select("arrival_ms", *REQUEST_COLUMNS).distinct(), "asked"))
    free = never_broadcast(store(free_by_class(
        asked.select(F.col("arrival_ms").alias("time_ms")), spans, ["class_id"], rules.quantum_ms, rules.cover_bits
    ).withColumnRenamed("time_ms", "arrival_ms"), "free-classes"))
    shapes = asked.select(*REQUEST_COLUMNS).distinct()
    pairs = capable_pairs(shapes, classes, eps=0.0)
    # scores for the ranking come first: the model may be fed other power values than the snapshot's
    scored = with_raw_scores(pairs, rules.profile, rules.overrides)
    facts = scorer(assemble_features(scored, rules.constant_power)).select(
        *REQUEST_COLUMNS, "class_id", "fit_raw", "watts", "p"
    )
    met = salted_join(asked, facts, REQUEST_COLUMNS, ["arrival_ms"])
    # both sides grow with the arrivals: copies for salting would outweigh the skew, which
    # adaptive execution splits at run time
    return met.join(free, ["arrival_ms", "class_id"]), free, asked


def rank_candidates(candidates: DataFrame, rules: PlacementRules) -> DataFrame:
    """Gate counts and scores among the safe candidates of each (arrival, request).

    ``pref`` numbers the candidates best first, unsafe ones last. A group has at most one
    row per machine class.
    """
    group = W.partitionBy("arrival_ms", *REQUEST_COLUMNS)
    safe = F.col("p") < F.lit(rules.tau)
    gated = candidates.withColumns(
        {
            "safe": F.coalesce(safe, F.lit(False)),
            "n_fit": F.sum("n_free").over(group),
            "n_safe": F.coalesce(F.sum(F.when(safe, F.col("n_free"))).over(group), F.lit(0)),
            "n_unscored": F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n_free"))).over(group), F.lit(0)),
            "fit_min": F.min(F.when(safe, F.col("fit_raw"))).over(group),
            "fit_max": F.max(F.when(safe, F.col("fit_raw"))).over(group),
            "watts_min": F.min(F.when(safe, F.col("watts"))).over(group),
            "watts_max": F.max(F.when(safe, F.col("watts"))).over(group),
        }
    )
    scored = with_scores(gated, rules.alpha, rules.profile)
    order = [F.desc("safe"), *score_order("first_free_id")]
    return scored.withColumn("pref", F.row_number().over(group.orderBy(*order)))


def placement_status(n_free: str, n_fit: str, n_safe: str, n_unscored: str, machine: str):
    """First gate that fails: free, large enough, scored, safe."""
    return (
        F.when(F.coalesce(F.col(n_free), F.lit(0)) == 0, F.lit(NO_FREE))
        .when(F.coalesce(F.col(n_fit), F.lit(0)) == 0, F.lit(NO_SUITABLE))
        .when((F.col(n_safe) == 0) & (F.col(n_unscored) == F.col(n_fit)), F.lit(SCORE_ERROR))
        .when(F.col(n_safe) == 0, F.lit(ALL_VIOLATE))
        .when(F.col(machine).isNull(), F.lit(FAILED))
        .otherwise(F.lit(SCHEDULED))
    )


def place_snapshot(
    tasks: DataFrame, machines: DataFrame, allocations: DataFrame, scorer: Scorer,
    rules: PlacementRules = PlacementRules(),
) -> DataFrame:
    """Every task with its status and, if scheduled, the best safe free machine at its arrival.

    Tasks are judged against the given ledger; placements made here are not fed back.
    """
    candidates, free, asked = class_candidates(tasks, machines, allocations, scorer, rules)
    ranked = rank_candidates(candidates, rules)
    best = ranked.filter("pref = 1").withColumn("machine_id", F.when(F.col("safe"), F.col("first_free_id")))
    outcome = best.select(
        "arrival_ms", *REQUEST_COLUMNS, "machine_id", "n_fit", "n_safe", "n_unscored",
        *[F.when(F.col("safe"), F.col(c)).alias(c) for c in ("p", "watts", "energy_score", "fit_score", "final_score")],
    )
    free_all = free.groupBy("arrival_ms").agg(F.sum("n_free").alias("n_free_all"))
    full = fill_requests(tasks)
    answers = asked.join(free_all, "arrival_ms", "left").join(outcome, ["arrival_ms", *REQUEST_COLUMNS], "left")
    status = placement_status("n_free_all", "n_fit", "n_safe", "n_unscored", "machine_id")
    return full.join(answers, ["arrival_ms", *REQUEST_COLUMNS], "left").select(
        "task_id",
        F.when(F.col("arrival_ms").isNull(), F.lit(NO_ARRIVAL)).otherwise(status).alias("status"),
        "machine_id",
        F.col("p").alias("sla_probability"),
        "watts",
        "energy_score",
        "fit_score",
        "final_score",
        F.lit(rules.model_used).alias("model_used"),
    )


def batch_assign(
    tasks: DataFrame, machines: DataFrame, allocations: DataFrame, scorer: Scorer,
    rules: PlacementRules = PlacementRules(), per_bucket: int = 100_000,
) -> DataFrame:
    """Conflict-free machines for tasks that arrive at the same instant, earlier task ids first.

    Every task asks its best unit; a unit serves as many of the earliest askers as it has free
    machines, and the others ask their next unit. All share one priority, so each round settles
    at least one more unit: the rounds are bounded by the number of units, not of tasks or
    machines, and all instants run together. A unit is a class, or several that score
    alike for every request of the instant; only where classes score alike for some of its
    requests and not for others is a unit a stretch along the machine ids. Scores stay those of the
    instant's snapshot. Instants without refusals leave the loop after their round.
    """
    classes, idle = _idle_classes(machines, allocations, rules)
    spans = never_broadcast(store(idle, "idle-spans"))
    safe = never_broadcast(store(
        rank_candidates(class_candidates(tasks, machines, allocations, scorer, rules, (classes, spans))[0], rules).filter("safe").select(
            "arrival_ms", *REQUEST_COLUMNS, "class_id", "n_free", "first_free_id", "p", "final_score",
            F.array(*score_order("first_free_id")[:-1]).alias("score"),
        ),
        "safe",
    ))
    units = never_broadcast(store(_units(safe), "units"))
    merged = safe.join(units, ["arrival_ms", "class_id"]).groupBy("arrival_ms", *REQUEST_COLUMNS, "unit").agg(
        F.sum("n_free").alias("n_free"), F.min("first_free_id").alias("first_free_id"), F.first("score").alias("score")
    )
    listed = _stretches(merged, units, spans, rules)
    sizes = listed.groupBy("arrival_ms", "unit", "stretch").agg(
        F.count(F.lit(1)).alias("_n"), F.min("machine_id").alias("_first")
    )
    order = W.partitionBy("arrival_ms", *REQUEST_COLUMNS).orderBy("score", "first_free_id")
    prefs = never_broadcast(store(
        merged.join(sizes, ["arrival_ms", "unit"], "left").withColumns(
            {
                "n_free": F.coalesce("_n", "n_free"), "first_free_id": F.coalesce("_first", "first_free_id"),
                "stretch": F.coalesce("stretch", F.lit(0)),
            }
        ).withColumn("pref", F.row_number().over(order)).drop("_n", "_first", "score"),
        "prefs",
    ))
    state = fill_requests(tasks).select(
        "task_id", "arrival_ms", *REQUEST_COLUMNS, F.lit(1).alias("pref")
    )
    settled: list[DataFrame] = []
    while True:
        asking = state.join(prefs, ["arrival_ms", *REQUEST_COLUMNS, "pref"])
        placed = cut_lineage(
            ordered_rank(
                asking, ["arrival_ms", "unit", "stretch"], ["task_id"],
                integer_bucket(F.col("task_id"), per_bucket), "slot",
            )
        )
        refused = placed.filter("slot > n_free")
        if refused.isEmpty():
            settled.append(placed)
            break
        open_instants = refused.select("arrival_ms").distinct()
        settled.append(placed.join(open_instants, "arrival_ms", "left_anti"))
        moving = placed.join(open_instants, "arrival_ms", "left_semi")
        state = moving.select(
            "task_id", "arrival_ms", *REQUEST_COLUMNS,
            (F.col("pref") + F.when(F.col("slot") > F.col("n_free"), 1).otherwise(0)).alias("pref"),
        )
    won = settled[0]
    for part in settled[1:]:
        won = won.unionByName(part)
    named = _name_machines(won, units, listed, spans, rules)
    members = spans.select("machine_id", "class_id").distinct()
    facts = safe.select("arrival_ms", *REQUEST_COLUMNS, "class_id", F.col("p").alias("sla_probability"), "final_score")
    scored = never_broadcast(named).join(members, "machine_id").join(facts, ["arrival_ms", *REQUEST_COLUMNS, "class_id"]).select(
        "task_id", "machine_id", "sla_probability", "final_score"
    )
    return tasks.select("task_id", "arrival_ms").join(scored, "task_id", "left").withColumn(
        "status", F.when(F.col("machine_id").isNotNull(), F.lit("assigned")).otherwise(F.lit("unassigned"))
    )


def _units(safe: DataFrame) -> DataFrame:
    """(arrival_ms, class_id, unit): classes that are safe for the same requests of an instant with equal scores share one.

    Two classes are told apart by two 64-bit hashes over their (request, score) rows and the number of those.
    """
    row = [*[F.col(c) for c in REQUEST_COLUMNS], F.col("score")]
    marks = safe.groupBy("arrival_ms", "class_id").agg(
        *[F.bit_xor(F.xxhash64(F.lit(i), *row)).alias(f"_mark{i}") for i in range(2)], F.count(F.lit(1)).alias("_rows")
    )
    twins = W.partitionBy("arrival_ms", "_mark0", "_mark1", "_rows")
    return marks.select("arrival_ms", "class_id", F.min("class_id").over(twins).alias("unit"))


def _stretches(merged: DataFrame, units: DataFrame, spans: DataFrame, rules: PlacementRules) -> DataFrame:
    """Idle machines of the units that score alike for some request but not for all, cut where the unit changes.

    Equal scores fall to the smaller machine id, so such units take turns along the ids:
    in the order of ids, neighbours of one unit form a stretch (arrival_ms, unit,
    stretch, slot, machine_id), and stretches can be ranked like units.
    """
    alike = W.partitionBy("arrival_ms", *REQUEST_COLUMNS, "score")
    tied = merged.withColumn("_alike", F.count(F.lit(1)).over(alike)).filter("_alike > 1")
    asked = tied.select("arrival_ms", "unit").distinct().join(units, ["arrival_ms", "unit"])
    instants = asked.select(F.col("arrival_ms").alias("time_ms"), "class_id")
    found = free_members(instants, spans, ["class_id"], rules.quantum_ms, rules.cover_bits)
    members = found.select(F.col("time_ms").alias("arrival_ms"), "class_id", "machine_id").join(asked, ["arrival_ms", "class_id"])
    along = W.partitionBy("arrival_ms").orderBy("machine_id")
    turn = F.coalesce(F.lag("unit").over(along) != F.col("unit"), F.lit(True))
    cut = members.withColumn("_turn", turn.cast("int")).withColumn("stretch", F.sum("_turn").over(along))
    nth = F.row_number().over(W.partitionBy("arrival_ms", "stretch").orderBy("machine_id"))
    return never_broadcast(store(cut.select("arrival_ms", "unit", "stretch", "machine_id", nth.alias("slot")), "stretches"))


def _name_machines(
    won: DataFrame, units: DataFrame, stretches: DataFrame, spans: DataFrame, rules: PlacementRules
) -> DataFrame:
    """The n-th asker of a unit gets its n-th free machine; the first one's is known already."""
    unit = ["arrival_ms", "unit", "stretch"]
    taken = never_broadcast(store(won.groupBy(*unit).agg(F.max("slot").alias("n_taken")).filter("n_taken > 1"), "shared"))
    asked = taken.filter("stretch = 0").join(units, ["arrival_ms", "unit"]).select(
        F.col("arrival_ms").alias("time_ms"), "unit", "class_id", F.col("n_taken").alias("n")
    )
    of_units = first_members(asked, spans, rules.quantum_ms, rules.cover_bits).select(
        F.col("time_ms").alias("arrival_ms"), "unit", F.lit(0).cast("bigint").alias("stretch"), "slot", "machine_id"
    )
    of_stretches = stretches.join(taken, unit).filter("slot <= n_taken").select(*unit, "slot", "machine_id")
    slots = of_units.unionByName(of_stretches).filter("slot > 1")
    return never_broadcast(won).join(slots, [*unit, "slot"], "left").select(
        "task_id", "arrival_ms", *REQUEST_COLUMNS,
        F.when(F.col("slot") == 1, F.col("first_free_id")).otherwise(F.col("machine_id")).alias("machine_id"),
    )
