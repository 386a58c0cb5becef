import random

from berthline.llm.grouping import connected, link_buckets
from tests.llm.helpers import components


def test_connected_equals_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    got = connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = components(nodes, edges)
    by_got, by_want = {}, {}
    for r in got:
        by_got.setdefault(r.comp, set()).add(r.node)
    for n, c in want.items():
        by_want.setdefault(c, set()).add(n)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bucket_links_equal_all_pairs_and_meet_few(spark):
    """A bucket of one large group, strangers in it, and many small buckets."""
    members = [(0, n) for n in range(300)] + [(k, (k * 37 + j * 11) % 400) for k in range(1, 200) for j in range(3)]
    members = sorted(set(members))
    linked = lambda a, b: (a < 250 and b < 250) or (a >= 250 and b >= 250 and a % 10 == b % 10)
    met = spark.sparkContext.accumulator(0)

    def verify(pairs):
        rows = pairs.collect()
        met.add(len(rows))
        return spark.createDataFrame([r for r in rows if linked(r.node, r.rep)], pairs.schema)

    got = {r.node: r.comp for r in link_buckets(spark.createDataFrame(members, "key int, node bigint"), verify).collect()}
    buckets = {}
    for k, n in members:
        buckets.setdefault(k, []).append(n)
    links = [(a, b) for ns in buckets.values() for a in ns for b in ns if a < b and linked(a, b)]
    want = components({n for _, n in members}, links)
    same = lambda groups: sorted(sorted(g) for g in groups.values())
    by_got, by_want = {}, {}
    for n in want:
        by_got.setdefault(got.get(n, n), []).append(n)
        by_want.setdefault(want[n], []).append(n)
    assert same(by_got) == same(by_want)
    assert met.value < 300 * 299 / 2 / 2
