import numpy as np
import pytest
from pyspark.sql import functions as F

from berthline.llm import multi_index_hash
from berthline.llm.multi_index_hash import BITS, SUBS, Coder, MultiIndex, learn
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF

VECTORS = "vec_id bigint, embedding array<float>, label int"


def inner(v, w):
    total = 0.0
    for a, b in zip(v, w, strict=True):
        total += float(a) * float(b)
    return total


def brute_force(rows, queries, k=20):
    """{query id: ranked (vec_id, score)} by comparing all pairs."""
    out = {}
    for q, v in queries:
        scored = [(-inner(v, w), i is None, i or 0, i) for i, w in rows if i != q]
        out[q] = [(i, -s) for s, _, _, i in sorted(scored, key=lambda t: t[:3])[:k]]
    return out


def results(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in found}) for q, found in want.items())
    return hits / sum(len(found) for found in want.values())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_recall_on_the_given_tables(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    got, want = results(LLM_QUERIES["op13_multi_index_hash"](spark, folder).collect()), brute_force(rows, queries)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        assert [s for _, s in found] == [inner(vectors[q], vectors[i]) for i, _ in found]


def test_all_rows_where_there_are_few(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8)]) for i in range(15)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = results(multi_index_hash.nearest_of_every_20th(df).collect())
    assert got == brute_force(rows, rows[:1])
    assert len(got[0]) == 14


def test_ties_copies_and_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) * rng.uniform(0.1, 9)]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(None, rows[3][1]), (40, rows[40][1]), (7, rows[7][1])]
    bad = [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] * 8), (480, [None] + [1.0] * 7), (500, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], VECTORS)
    clashing = df.selectExpr("*", *[f"label AS {c}" for c in ("_id", "_vec", "_code", "q", "rank", "score", "query_id")])
    got = results(multi_index_hash.nearest_of_every_20th(clashing.repartition(6)).collect())
    queries = {i: v for i, v in rows if i is not None and i % 20 == 0}
    want = brute_force(rows, list(queries.items()))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, found in got.items():
        order = [(-s, i is None, i or 0) for i, s in found]
        assert order == sorted(order) and len(found) == 20


def test_no_rows_and_single_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0], 0)], VECTORS)
    for rows in (df, df.filter("1 = 0"), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        got = multi_index_hash.nearest_of_every_20th(rows)
        assert got.count() == 0 and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_queries_with_few_rows_in_reach_are_asked_again(spark):
    rng = np.random.default_rng(7)
    heap = [(i + 1, [float(np.float32(c)) for c in 1 + 0.001 * rng.normal(size=8)]) for i in range(300)]
    far = (0, [-1.0, 1.0] * 4)
    df = spark.createDataFrame([(i, v, 0) for i, v in [far, *heap]], VECTORS)
    got = results(multi_index_hash.nearest(df, F.col("_id") == 0).collect())
    assert len(got[0]) == 20
    assert recall(got, brute_force([far, *heap], [far])) >= 0.9


@pytest.mark.parametrize("radius", [0, 3, 17, 40, 64, BITS])
def test_probing_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 256, size=(500, SUBS), dtype=np.uint8)
    codes[:200] = codes[0] ^ np.packbits(rng.random((200, BITS)) < rng.uniform(0, 0.5, (200, 1)), axis=1)
    index = MultiIndex(codes)
    for q in range(20):
        apart = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        assert index.within(codes[q], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_codes_keep_angles():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 20))
    coder = learn(x, float(np.linalg.norm(x, axis=1).max()))
    assert isinstance(coder, Coder) and coder.rotation.shape == (21, BITS)
    codes = coder.codes(x)
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    near = x @ x.T
    assert np.corrcoef(apart[np.triu_indices(400, 1)], near[np.triu_indices(400, 1)])[0, 1] < -0.6
