import math

import numpy as np
import pytest

from berthline.llm import qd_whitening
from berthline.llm.bidiagonal import bidiagonalise, eigenpairs, squared_values
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF

VECTORS = "vec_id bigint, embedding array<float>, label int"


def whole(rows):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]


def check(got, rows, components=32):
    """Rows (id, vector) against numpy on the covariance; returns the components found."""
    x = whole([v for _, v in rows])
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = max((r.component for r in got), default=0)
    assert k == min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k
    exact = sorted((i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for (i, _), v in zip(rows, x, strict=True))
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == exact
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    gaps = np.abs(np.diff(values)) / values[0]
    for j in range(k):
        if min(gaps[max(j - 1, 0) : j + 1], default=1) > 1e-6:  # else the components are not unique
            mine = sorted((r.vec_id, r.whitened) for r in got if r.component == j + 1)
            far = [max(abs(a - b) for (_, a), (_, b) in zip(mine, sorted(theirs), strict=True)) for theirs in (
                [(i, w) for (i, _), w in zip(rows, sign * white[:, j], strict=True)] for sign in (1, -1))]
            assert min(far) < 1e-8
    for r in got:
        assert r.n == n and r.identity_error <= 1e-10
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    return k


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert check(LLM_QUERIES["op11_qd_whitening"](spark, SF).collect(), rows) == 32


def test_messy_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6)]) for i in range(40)]
    good += [(7, good[7][1]), (7, good[8][1]), (100, good[3][1])] + [(200 + i, good[0][1]) for i in range(30)]
    bad = [
        (300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [1.0] * 5 + [float("inf")]),
        (305, [1.0] * 3), (306, [3e38] * 6),
    ]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], VECTORS)
    clashing = df.selectExpr("*", "label AS _id", "label AS _vec", "label AS component", "label AS n", "label AS r")
    assert check(qd_whitening.whitening_report(clashing.repartition(7)).collect(), good) == 6
    unnamed = spark.createDataFrame([(None, v, 0) for _, v in good], VECTORS)
    assert qd_whitening.whitening_report(unnamed).filter("vec_id IS NULL").count() == 6 * len(good)


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    for rows in (df, df.limit(1), df.filter("1 = 0")):
        got = qd_whitening.whitening_report(rows)
        assert got.count() == 0 and len(got.columns) == 7


def test_rows_that_span_fewer_dimensions(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-3, 4, size=(50, 2)) @ rng.integers(-2, 3, size=(2, 5))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(flat)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert check(qd_whitening.whitening_report(df).collect(), rows) == 2


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**40 * (i - 2)), float(i * i)]) for i in range(5)]
    got = qd_whitening.whitening_report(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    x = whole([v for _, v in rows])
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        exact = sum((5 * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == (exact if exact < 1 << 63 else None)


def test_triangles_of_many_tasks_stack_to_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a scan task for every file
    try:
        assert check(qd_whitening.whitening_report(df.repartition(70)).collect(), rows) == 4
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("kind", ["plain", "graded", "repeated", "equal", "wide"])
@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_solver_equals_svd(d, kind):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(4 * d, d)) if kind != "wide" else rng.normal(size=(max(d // 2, 1), d))
    if kind == "graded":
        x = x * np.logspace(0, -6, d)
    if kind == "repeated":
        x[:, d // 2 :] = x[:, : d - d // 2]
    if kind == "equal":
        x = np.repeat(np.eye(d) * 3, 2, axis=0)
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    a, b, v = bidiagonalise(r)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    want = np.concatenate([want, np.zeros(d - len(want))])
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    sure = want > 1e-16 * want[0]
    assert np.abs(squared_values(a, b) / want[0] - want / want[0]).max() < 1e-13
    if kind == "plain":
        assert np.abs(squared_values(a, b)[sure] / want[sure] - 1).max() < 1e-12
    _, kept, vectors = eigenpairs(r, 32, 1e-22)
    assert np.abs(vectors.T @ vectors - np.eye(len(kept))).max() < 1e-12
    assert np.abs(x.T @ (x @ vectors) - vectors * kept).max() < 1e-11 * want[0]
