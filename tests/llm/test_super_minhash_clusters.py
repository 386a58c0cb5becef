"""Sets that buckets connect without being similar."""

import numpy as np
from pyspark.sql import functions as F

from berthline.llm import super_minhash

WORDS = 300


def _node(i, size):
    return f"{i:032x}{size:08x}"


def _chain(spark, n):
    """Texts of which each shares a third of its words with the next, and buckets of neighbours."""
    texts = [" ".join(f"w{WORDS * 2 // 3 * i + k}" for k in range(WORDS)) for i in range(n)]
    size = WORDS - super_minhash.SHINGLE + 1
    rows = spark.createDataFrame([(_node(i, size), t) for i, t in enumerate(texts)], "node string, _text string")
    buckets = [(i, _node(j, size)) for i in range(n - 1) for j in (i, i + 1)]
    labels = spark.createDataFrame([], "node string, comp string")
    return spark.createDataFrame(buckets, "key bigint, node string"), labels, rows


def test_a_chain_of_sets_that_are_not_similar_sends_no_text(spark, monkeypatch):
    def no_block(*_):
        def run(table):
            raise AssertionError(f"{table.num_rows} texts sent")
        return run

    monkeypatch.setattr(super_minhash, "_compare_block", no_block)
    monkeypatch.setattr(super_minhash, "BLOCK_SETS", 4)
    buckets, labels, texts = _chain(spark, 40)
    assert super_minhash._link_clusters(buckets, labels, texts, super_minhash.SHINGLE, (85, 100)).count() == 0


def test_similar_members_of_a_crowded_key_are_joined(spark, monkeypatch):
    monkeypatch.setattr(super_minhash, "KEY_MEMBERS", 7)
    monkeypatch.setattr(super_minhash, "KEY_ROWS", 20)
    monkeypatch.setattr(super_minhash, "BLOCK_SETS", 4)
    rng = np.random.default_rng(3)
    texts = []
    for family in range(12):
        base = [f"f{family}x{k}" for k in range(int(rng.integers(30, 2000)))]
        for i in range(4):
            texts.append(" ".join(["lead", *base, *[f"t{family}y{i}" for _ in range(i % 2)]]))
    size = [len(set(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))) for t in texts]
    rows = [(_node(i, n), t) for i, (n, t) in enumerate(zip(size, texts))]
    buckets = spark.createDataFrame([(1, node) for node, _ in rows], "key bigint, node string")
    labels = spark.createDataFrame([], "node string, comp string")
    found = super_minhash._link_clusters(buckets, labels, spark.createDataFrame(rows, "node string, _text string"), 5, (85, 100))
    groups = {frozenset(int(node[:32], 16) for node in r.nodes) for r in found.groupBy("comp").agg(F.collect_list("node").alias("nodes")).collect()}
    assert groups == {frozenset(range(4 * f, 4 * f + 4)) for f in range(12)}


def test_no_similar_pair_is_ruled_out():
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 2, 7, 60, 400, 5000, 70_000):
        base = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        for share in (0.0, 0.05, 0.1, 0.25, 0.5):
            other = base.copy()
            other[: int(share * size)] = rng.integers(1, 1 << 62, int(share * size), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([other, rng.integers(1, 1 << 62, int(share * size / 4), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    maps = [super_minhash.set_bitmap(s) for s in sets]
    for least in (20, 80, 85):
        found = list(super_minhash.may_be_similar(np.zeros(len(sets), dtype=np.int64), n, maps, (least, 100)))
        pairs = {tuple(sorted(p)) for i, j in found for p in zip(i.tolist(), j.tolist())}
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= least * (len(a) + len(sets[j]) - both):
                    assert (j, i) in pairs
    assert len(pairs) < len(sets) * (len(sets) - 1) // 4
