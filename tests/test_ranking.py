import random

import pytest

from berthline.functions.scoring import PowerOverrides
from berthline.operators import candidates as cd
from berthline.operators import pruning, ranking
from berthline.schemas import FEATURE_COLUMNS, REQUEST_COLUMNS
from tests.helpers import brute_rank, fleet, machine, task, workload


def ranked(spark, machines, tasks, **kwargs):
    out = ranking.rank_placements(workload(spark, tasks), fleet(spark, machines), **kwargs)
    return {(r.task_id, r["rank"]): r for r in out.collect()}


def test_single_candidate_floored_keeps_raw_fit_and_full_energy(spark):
    row = ranked(spark, [machine(1, 0)], [task(1, cpu=2, ram=4)])[(1, 1)]
    assert row.energy_score == 1.0
    assert row.fit_score == pytest.approx(row.fit_raw) == pytest.approx((0.5 + 0.5) / 4)


def test_single_candidate_plain_scores_zero(spark):
    row = ranked(spark, [machine(1, 0)], [task(1, cpu=2, ram=4)], profile="plain")[(1, 1)]
    assert (row.energy_score, row.fit_score, row.final_score) == (0.0, 0.0, 0.0)


def test_no_candidate_gives_no_row(spark):
    assert ranked(spark, [machine(1, 0)], [task(1, cpu=99)]) == {}


def test_request_equal_to_remaining_fits_and_zero_gpu_machine_serves_zero_gpu(spark):
    rows = ranked(spark, [machine(1, 0, used=(1, 0, 0, 2))], [task(1, cpu=3, ram=6), task(2, cpu=3, gpu=1, ram=6)])
    assert set(rows) == {(1, 1)}
    assert rows[(1, 1)].fit_raw == 0.0


@pytest.mark.parametrize("alpha", [-0.1, 1.1])
def test_invalid_alpha_is_rejected_even_without_candidates(spark, alpha):
    with pytest.raises(ValueError):
        ranking.rank_placements(workload(spark, [task(1, cpu=99)]), fleet(spark, [machine(1)]), alpha=alpha)


def test_identical_machines_tie_to_the_lower_id(spark):
    rows = ranked(spark, [machine(i, 4) for i in (9, 3, 7)], [task(1)], k=2)
    assert [rows[(1, i)].machine_id for i in (1, 2)] == [3, 7]


def test_alpha_edges_follow_one_objective(spark):
    pool = [machine(i, i % 5) for i in range(5)]
    by_fit = ranked(spark, pool, [task(1, cpu=2, ram=2)], alpha=0.0, k=5)
    by_energy = ranked(spark, pool, [task(1, cpu=2, ram=2)], alpha=1.0, k=5)
    assert [by_fit[(1, i)].fit_score for i in range(1, 6)] == sorted(by_fit[(1, i)].fit_score for i in range(1, 6))
    assert [by_energy[(1, i)].watts for i in range(1, 6)] == sorted(by_energy[(1, i)].watts for i in range(1, 6))


def test_override_counts_even_when_the_total_is_zero(spark):
    row = ranked(
        spark, [machine(1, 0)], [task(1, cpu=2, ram=4)],
        overrides=PowerOverrides(gpu_power_per_core=5.0, cpu_power_per_core=0.0, ram_power_per_gb=0.0),
    )[(1, 1)]
    assert row.watts == 0.1


def test_missing_machine_columns_are_listed(spark):
    bare = fleet(spark, [machine(1)]).drop("cpu_watts", "ram_used_gb")
    with pytest.raises(ValueError, match="cpu_watts.*ram_used_gb"):
        ranking.rank_placements(workload(spark, [task(1)]), bare)


@pytest.mark.parametrize("prune", [False, True])
@pytest.mark.parametrize("profile,alpha,overrides", [
    ("floored", 0.5, {}), ("floored", 0.3, {3: 0.2}), ("plain", 0.4, {}), ("plain", 0.7, {0: 2.0, 1: 0.01}),
    ("floored", 0.0, {}), ("floored", 1.0, {}),
])
def test_matches_one_by_one_scoring(spark, profile, alpha, overrides, prune):
    rng = random.Random(5)
    pool = [
        machine(i, i % 5, used=(rng.randrange(4), rng.choice([0, 128]) if i % 5 in (1, 2, 4) else 0, 0, rng.randrange(8)),
                power=(float(rng.randrange(100)), float(rng.randrange(200))))
        for i in range(40)
    ]
    tasks = [task(i, rng.randrange(0, 9), rng.choice([0, 0, 100, 600.5]), rng.choice([0, 0, 7]), rng.randrange(1, 40))
             for i in range(60)]
    names = ["cpu_power_per_core", "gpu_power_per_core", "gpu_vram_power_per_gb", "ram_power_per_gb"]
    got = ranked(spark, pool, tasks, profile=profile, alpha=alpha, k=4, prune=prune,
                 overrides=PowerOverrides(**{names[i]: v for i, v in overrides.items()}))
    for t in tasks:
        want = brute_rank(pool, t[2:6], alpha, profile, overrides)[:4]
        rows = [got[(t[0], i + 1)] for i in range(len(want))]
        assert [r.machine_id for r in rows] == [w[3] for w in want]
        assert [r.final_score for r in rows] == pytest.approx([w[0] for w in want], abs=1e-8)
        assert (t[0], len(want) + 1) not in got


def test_feasible_counts_keep_tasks_without_machine(spark):
    out = cd.feasible_counts(workload(spark, [task(1, cpu=99), task(2)]), fleet(spark, [machine(1), machine(2, 4)]))
    assert {r.task_id: r.n_feasible for r in out.collect()} == {1: 0, 2: 2}


def test_features_come_in_order_with_power_from_snapshot_or_constants(spark):
    pairs = cd.capable_pairs(
        cd.request_shapes(workload(spark, [task(1)])), cd.machine_classes(fleet(spark, [machine(1, 4, power=(7.0, 8.0))]))
    )
    seen = cd.align_features(cd.assemble_features(pairs), FEATURE_COLUMNS).first()
    assert seen.asDict()["current_cpu_power_w"] == 7.0 and list(seen.asDict()) == FEATURE_COLUMNS
    fixed = cd.assemble_features(pairs, constant_power=True).first()
    assert (fixed.current_cpu_power_w, fixed.current_gpu_power_w) == (50.0, 100.0)


def test_null_requests_count_as_zero(spark):
    tasks = workload(spark, [(1, 0, None, None, None, None, 1.0)])
    assert cd.fill_requests(tasks).select(*REQUEST_COLUMNS).first() == (0.0, 0.0, 0.0, 0.0)


def real_world(rng, n_machines, n_tasks):
    """Machines of mixed makes and usage, and requests that hardly repeat."""
    pool = []
    for i in range(n_machines):
        spec = dict(
            cpu_cores_total=float(rng.randrange(4, 129)), ram_total_gb=float(rng.randrange(8, 513)),
            cpu_watts=rng.uniform(40, 400), gpu_watts=rng.uniform(0, 600),
            gpu_cores_total=float(rng.choice([0, 1024, 8192])), gpu_vram_total_gb=float(rng.choice([0, 16, 128])),
        )
        used = [spec[c] * rng.random() for c in ("cpu_cores_total", "gpu_cores_total", "gpu_vram_total_gb", "ram_total_gb")]
        pool.append(machine(i, 0, used=used, **spec))
    tasks = [task(i, rng.uniform(0.5, 16), rng.choice([0, 0, rng.uniform(1, 2000)]), rng.choice([0, 0, rng.uniform(1, 30)]),
                  rng.uniform(0.5, 64)) for i in range(n_tasks)]
    return pool, tasks


@pytest.mark.parametrize("k,alpha,profile", [(1, 0.5, "floored"), (3, 0.2, "plain"), (5, 0.8, "floored")])
def test_pruning_changes_no_rank(spark, k, alpha, profile):
    pool, tasks = real_world(random.Random(k), 150, 300)
    got = ranked(spark, pool, tasks, profile=profile, alpha=alpha, k=k, prune=True)
    assert len(got) == sum(min(k, len(brute_rank(pool, t[2:6], alpha, profile))) for t in tasks)
    for t in tasks:
        for i, w in enumerate(brute_rank(pool, t[2:6], alpha, profile)[:k]):
            row = got[(t[0], i + 1)]
            assert row.machine_id == w[3] and row.final_score == pytest.approx(w[0], abs=1e-8)


def test_real_valued_requests_form_few_pairs(spark):
    pool, _ = real_world(random.Random(1), 400, 0)
    rng = random.Random(2)
    centres = [(rng.uniform(1, 16), rng.choice([0, rng.uniform(100, 2000)]), rng.choice([0, rng.uniform(1, 30)]), rng.uniform(1, 64))
               for _ in range(25)]
    tasks = [task(i, *[c * rng.uniform(0.99, 1.01) for c in rng.choice(centres)]) for i in range(5000)]
    shapes = cd.request_shapes(workload(spark, tasks)).drop("n_tasks").cache()
    classes = cd.machine_classes(fleet(spark, pool), False).cache()
    placed, survivors = pruning.surviving_classes(shapes, classes, 0.5, k=1)
    few, all_pairs = pruning.pruned_pairs(placed, survivors).count(), cd.capable_pairs(shapes, classes).count()
    assert shapes.count() == 5000 and all_pairs > 200_000
    assert few * 10 <= all_pairs


def test_requests_that_are_no_numbers_find_no_machine(spark):
    rows = ranked(spark, [machine(1, 0)], [task(1, cpu=float("nan")), task(2, cpu=float("inf")), task(3)], prune=True)
    assert set(rows) == {(3, 1)}
