"""Groups of linked items from candidate buckets, without listing the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.session import store

#: Representatives of a bucket in the first round of link_apart, and how they multiply from round to round.
REPRESENTATIVES, WIDEN = 1, 64
#: Parts into which the members of every bucket are dealt, so that a crowded one is not joined in one task.
PARTS = 64

Near = Callable[[Column, Column], Column]


def _any(node: Column, rep: Column) -> Column:
    return F.lit(True)


def _roots(parent: DataFrame) -> DataFrame:
    """(node, comp): where following ``parent`` (node, parent) ends; roots are their own parents."""
    while True:
        two = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_2"))
        four = parent.select(F.col("node").alias("_2"), F.col("parent").alias("_3"))
        further = store(parent.join(two, "parent").join(four, "_2").select("node", "parent", "_3"), "hooks")
        parent = further.select("node", F.col("_3").alias("parent"))
        if further.filter(F.col("parent") != F.col("_3")).isEmpty():
            return parent.select("node", F.col("parent").alias("comp"))


def _follow(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` with the components that ``moved`` (node, comp) gives to their components."""
    to = moved.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    return labels.join(to, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of ``edges`` (a, b); comp is one of the component's nodes.

    Each round hooks every node to its smallest neighbour, follows the hooks to their
    roots and contracts the edges, so the number of rounds grows with the logarithm of
    the largest component. All state lives in tables of the shared folder.
    """
    current = store(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    labels = None
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("parent")
        )
        roots = _roots(store(hooks, "hooks"))
        labels = roots if labels is None else store(_follow(labels, roots), "labels")
        a, b = (roots.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")) for c in "ab")
        current = store(
            current.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct(),
            "edges",
        )
    if labels is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))


def with_ends(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (key, node, ...; read twice) with _lo and _hi, the least and the greatest ``value`` of the key.

    The ends of a key's parts are found first, so no task sees more than a part of a crowded key,
    or the PARTS ends of one.
    """
    dealt, whole = _dealt(rows), W.partitionBy("key")
    parts = dealt.groupBy("key", "_part").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ends = parts.select("key", "_part", F.min("_lo").over(whole).alias("_lo"), F.max("_hi").over(whole).alias("_hi"))
    return dealt.join(ends, ["key", "_part"]).drop("_part")


def first_links(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Near = _any
) -> DataFrame:
    """(node, comp) after comparing every node with one other, the smallest head of its buckets that is near."""
    headed = with_ends(buckets, "node").withColumnRenamed("_lo", "rep")
    pairs = store(
        headed.filter((F.col("node") != F.col("rep")) & near(F.col("node"), F.col("rep")))
        .groupBy("node").agg(F.min("rep").alias("rep")),
        "pairs",
    )
    # every node has one link at most, to a smaller node: the links are a forest already
    links = store(verify(pairs).select("node", F.col("rep").alias("parent")), "links")
    tops = links.select(F.col("parent").alias("node")).distinct().join(links, "node", "left_anti")
    return _roots(store(links.unionByName(tops.select("node", F.col("node").alias("parent"))), "hooks"))


def apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp) of the buckets that hold more than one component."""
    known = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    return with_ends(known, "comp").filter(F.col("_lo") != F.col("_hi")).select("key", "node", "comp")


def join_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after more links (a, b), a stored table."""
    if links.isEmpty():
        return labels
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
    labels = store(labels.unionByName(fresh), "labels")
    a, b = (labels.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")) for c in "ab")
    between = links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return store(_follow(labels, connected(between)), "labels")


def link_apart(
    buckets: DataFrame, labels: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Near = _any
) -> DataFrame:
    """``labels`` (node, comp) after every two components that share a bucket have been compared.

    Members are compared with representatives of their bucket, not with each other. The
    next round takes more representatives and leaves out the ones that have met the whole
    bucket, until no bucket holds two components that have not been compared. So no link
    between two components is missed, and a bucket of copies costs few pairs a member.
    """
    members, tried = buckets.select("key", "node"), []
    width, turn = REPRESENTATIVES, 0
    while True:
        live = store(apart(members, labels), "buckets")
        if live.isEmpty():
            return labels
        reps = store(
            live.groupBy("key", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(width)).alias("_sub"))
            .agg(F.min(F.struct("node", "comp")).alias("_r"))
            .select("key", F.col("_r.node").alias("rep"), F.col("_r.comp").alias("_rep_comp")),
            "reps",
        )
        # representatives go to the parts that their bucket has, so that its members meet them part by part
        dealt = _dealt(live)
        sent = dealt.select("key", "_part").distinct().join(reps, "key")
        fresh = (
            dealt.join(sent, ["key", "_part"])
            .filter((F.col("comp") != F.col("_rep_comp")) & near(F.col("node"), F.col("rep")))
            .select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")).distinct()
        )
        for old in tried:
            fresh = fresh.join(old, ["node", "rep"], "left_anti")
        pairs = store(fresh, "pairs")
        tried.append(pairs)
        links = store(verify(pairs).select(F.col("node").alias("a"), F.col("rep").alias("b")), "links")
        labels = join_links(labels, links)
        met = reps.select("key", F.col("rep").alias("node"))
        members = live.select("key", "node").join(met, ["key", "node"], "left_anti")
        width, turn = width * WIDEN, turn + 1


def link_buckets(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Near = _any
) -> DataFrame:
    """(node, comp) of the components that the verified links inside buckets form.

    ``buckets`` has distinct (key, node) rows and is read several times; ``verify`` takes
    pairs (node, rep) and returns those that are links; ``near`` is a cheap test that every link
    passes. Members that turn out to be linked
    need no further comparison, as one more link inside a component changes nothing. Nodes
    without a link may be left out.
    """
    return link_apart(buckets, first_links(buckets, verify, near), verify, near)
