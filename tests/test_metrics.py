import math
import random

import pytest

from berthline.functions.numeric import apply_temperature, binarize, logit, sigmoid
from berthline.operators import metrics as mt
from berthline.operators import reports as rp
from berthline.operators import splits
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


RNG = random.Random(8)
ROWS = [(int(RNG.random() < 0.4), RNG.choice([0.1, 0.25, 0.5, 0.75, RNG.random()])) for _ in range(500)]


def test_auc_counts_ties_half(spark):
    pos, neg = [p for y, p in ROWS if y], [p for y, p in ROWS if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert mt.roc_auc(frame(spark, ROWS)).first()[0] == pytest.approx(wins / len(pos) / len(neg))


def test_average_precision_is_stepwise(spark):
    n_pos, area, last = sum(y for y, _ in ROWS), 0.0, 0.0
    for s in sorted({p for _, p in ROWS}, reverse=True):
        tp, fp = sum(1 for y, p in ROWS if y and p >= s), sum(1 for y, p in ROWS if not y and p >= s)
        area, last = area + (tp / n_pos - last) * tp / (tp + fp), tp / n_pos
    assert mt.average_precision(frame(spark, ROWS)).first()[0] == pytest.approx(area)


def test_single_class_labels(spark):
    only = frame(spark, [(0, 0.2), (0, 0.9)])
    assert mt.roc_auc(only).first()[0] is None
    assert mt.average_precision(only).first()[0] == 0.0
    m = mt.classification_metrics(only).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 0.5)
    assert mt.class_balance(only).first().pos_weight == 1.0


def test_log_loss_is_finite_at_zero_and_one(spark):
    value = mt.log_loss(frame(spark, [(1, 0.0), (0, 1.0), (1, 1.0)])).first()[0]
    assert math.isfinite(value) and value == pytest.approx(2 * 36.0436533891 / 3, rel=1e-6)


def test_sweep_counts_every_threshold_like_a_full_scan(spark):
    edge = ROWS + [(1, t) for t in mt.threshold_grid()] + [(0, 0.0), (1, 1.0)]
    for r in mt.threshold_sweep(frame(spark, edge)).collect():
        assert (r.tp, r.fp) == (sum(1 for y, p in edge if y and p >= r.threshold),
                                sum(1 for y, p in edge if not y and p >= r.threshold))
        assert r.tp + r.fp + r.tn + r.fn == len(edge)


def test_pick_threshold_and_its_fallback(spark):
    data = frame(spark, ROWS)
    sweep = mt.threshold_sweep(data).collect()
    want = max((r for r in sweep if r.recall >= 0.9), key=lambda r: (r.precision, r.recall, r.f1, -r.threshold))
    chosen = mt.pick_threshold(data, 0.9).first()
    assert (chosen.threshold, chosen.rule) == (want.threshold, mt.RULE_RECALL)
    fallback = mt.pick_threshold(data, 1.5).first()
    assert fallback.rule == mt.RULE_F1 and fallback.f1 == max(r.f1 for r in sweep)


def test_temperature_grid_and_choice(spark):
    assert len(mt.temperature_grid()) == 91 and mt.temperature_grid()[-1] == pytest.approx(5.0)
    best = mt.fit_temperature(frame(spark, ROWS)).first()
    all_of_them = {r.temperature: r.log_loss for r in mt.temperature_sweep(frame(spark, ROWS)).collect()}
    assert best.log_loss == pytest.approx(min(all_of_them.values()))


def test_scalars(spark):
    row = spark.createDataFrame([(0.5,)], "p double").select(
        binarize("p").alias("a"), binarize("p", strict=True).alias("b"), apply_temperature("p", 2.0).alias("c"),
        logit(F.lit(0.0)).alias("d"), sigmoid(F.lit(0.0)).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.e) == (1, 0, 0.5, 0.5) and row.d == pytest.approx(-13.8155, abs=1e-3)


def test_stratified_split_is_exact_and_repeatable(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1003)], "row_id long, y int")
    counts = {}
    first = splits.stratified_split(rows, "y", "row_id", buckets=64)
    for r in first.collect():
        counts.setdefault(r.y, []).append(r.is_val)
    assert {y: sum(v) for y, v in counts.items()} == {0: round(0.2 * 668), 1: round(0.2 * 335)}
    again = splits.stratified_split(rows.repartition(7), "y", "row_id", buckets=64)
    assert set(first.collect()) == set(again.collect())


def test_folds_deal_each_class_out_evenly(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(99)], "row_id long, y int")
    sizes = {(r.y, r.fold): r["count"] for r in splits.assign_folds(rows, "y", "row_id").groupBy("y", "fold").count().collect()}
    assert sizes == {(y, f): n for y, n in ((0, 22), (1, 11)) for f in range(3)}


def test_scaling_leaves_constant_columns_finite(spark):
    data = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in splits.standard_scale(data, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_quantiles_are_exact_for_a_hot_key(spark):
    import numpy as np

    values = [(("a" if i % 3 else "b"), RNG.random()) for i in range(300)]
    out = rp.quantiles(spark.createDataFrame(values, "k string, v double"), ["k"], "v", {"q1": 0.25, "m": 0.5})
    for r in out.collect():
        own = [v for k, v in values if k == r.k]
        assert (r.q1, r.m) == pytest.approx(tuple(np.quantile(own, [0.25, 0.5])))


def test_histogram_clamps_one_and_shows_empty_bins(spark):
    bins = {r.bin: r.n for r in rp.sla_histogram(spark.createDataFrame([(1.0,), (0.0,), (None,)], "sla_probability double")).collect()}
    assert len(bins) == 20 and bins[19] == 1 and bins[0] == 1 and sum(bins.values()) == 2


def test_rows_without_a_score_are_left_out_everywhere(spark):
    whole = [(1, 0.9), (0, 0.2), (1, 0.6), (0, 0.7)]
    rows = spark.createDataFrame([*whole, (1, None), (0, None), (None, 0.5)], "y int, p double")
    clean = spark.createDataFrame(whole, "y int, p double")
    for metric in (mt.roc_auc, mt.average_precision, mt.log_loss, mt.threshold_sweep, mt.fit_temperature, mt.evaluate_report):
        assert sorted(metric(rows).collect()) == sorted(metric(clean).collect())
    assert tuple(mt.unscored_counts(rows).first()) == (3, 4)


def test_a_null_key_is_a_key(spark):
    rows = spark.createDataFrame([(k, y, p) for k in ("a", None) for y, p in ((1, 0.9), (0, 0.2), (1, 0.1))], "k string, y int, p double")
    for metric in (mt.roc_auc, mt.average_precision, mt.evaluate_report):
        got = {r["k"]: tuple(r)[1:] for r in metric(rows, keys=["k"]).collect()}
        assert got[None] == got["a"]
