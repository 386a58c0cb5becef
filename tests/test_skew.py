import random

from pyspark.sql import functions as F

from berthline.operators.skew import integer_bucket, ordered_rank, running_totals, salted_join


def test_running_totals_agree_at_every_depth(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), x, rng.randrange(-5, 9)) for x in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, x long, v long")
    want = {}
    for k in "ab":
        total, own = 0, sorted(r for r in rows if r[0] == k)
        for i, (_, x, v) in enumerate(own):
            total += v
            want[(k, x)] = (total, own[i + 1][1] if i + 1 < len(own) else None)
    widths = [[7], [7, 70], [7, 70, 700]]
    for w in widths:
        out = running_totals(df, ["k"], "x", {"t": "v"}, [integer_bucket(F.col("x"), i) for i in w], following="nxt")
        assert {(r.k, r.x): (r.t, r.nxt) for r in out.collect()} == want


def test_ordered_rank_without_keys_and_with_nested_buckets(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x long")
    ranked = ordered_rank(df, [], ["x"], [integer_bucket(F.col("x"), 4), integer_bucket(F.col("x"), 40)])
    assert all(r["rank"] == r.x + 1 for r in ranked.collect())


def test_salted_join_keeps_every_row_once(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, i long")
    right = spark.createDataFrame([(1, "one"), (3, "three")], "k long, name string")
    inner = salted_join(left, right, ["k"], ["i"])
    outer = salted_join(left, right, ["k"], ["i"], "left")
    assert inner.count() == 201 and outer.count() == 300 and outer.select("i").distinct().count() == 300
