"""Exact duplicates by sorting documents on their normalised content.

Splitters taken from a sample cut the order of (prefix, hash, tie) into ranges of about
equal size. Every range is sorted by an external sort, after which equal texts are
neighbours, and each text is compared in full with the one before it. The tie, a hash of the
id, is part of the splitters, so a text that many documents share is spread over as many
ranges as its share of the rows; the few groups at the edges of a range are put together
afterwards from one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.session import store

#: Characters that `[\x20\x09-\x0D]` deletes.
WHITESPACE = "\t\n\x0b\x0c\r "
#: Leading characters of a text in a splitter.
PREFIX = 16
#: Sampled rows for each range.
SAMPLES = 40
#: Ranges for each shuffle partition.
RANGES = 2
#: Bound on the splitters in a plan; beyond it ranges grow and their sorts spill.
MAX_RANGES = 8192
SEED = 20


def normalised(text: Column) -> Column:
    """The text without whitespace; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def _keys(norm: Column, doc_id: Column, text: Column) -> Column:
    return F.struct(
        F.substring(norm, 1, PREFIX).alias("p"), F.xxhash64(norm).alias("h"), F.xxhash64(doc_id, text).alias("t")
    )


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple]:
    """``ranges - 1`` keys that cut the sorted sample into equal parts; bounded by SAMPLES a range."""
    if ranges < 2:
        return []
    wanted = SAMPLES * ranges
    some = rows if total <= wanted else rows.sample(min(1.0, wanted / total), SEED)
    keys = some.select(_keys(normalised(F.col("_text")), F.col("_id"), F.col("_text")).alias("k")).select("k.*")
    found = sorted(((r.p.encode(), r.h, r.t), tuple(r)) for r in keys.collect())
    cuts = [found[i * len(found) // ranges][1] for i in range(1, ranges)] if found else []
    return list(dict.fromkeys(cuts))


def _range_of(key: Column, splitters: list[tuple]) -> Column:
    """Number of splitters that are not above the key, by binary search."""
    if not splitters:
        return F.lit(0)
    table = F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(h).cast("bigint").alias("h"), F.lit(t).cast("bigint").alias("t"))
        for p, h, t in splitters
    ])

    def halve(state: Column, _: Column) -> Column:
        middle = ((state["lo"] + state["hi"]) / 2).cast("int")
        above = F.get(table, middle) <= key
        return F.when(state["lo"] >= state["hi"], state).otherwise(
            F.when(above, F.struct((middle + 1).alias("lo"), state["hi"].alias("hi")))
            .otherwise(F.struct(state["lo"].alias("lo"), middle.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    steps = F.array(*[F.lit(i) for i in range(len(splitters).bit_length() + 1)])
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _sorted_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their group inside a range (_bucket, _gnum).

    A group whose hash is a splitter's may go on in the next range (_edge); its first row
    keeps the text for the comparison there.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    total = rows.count()
    ranges = max(1, min(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES, total // SAMPLES))
    splitters = _splitters(rows, total, ranges)
    keyed = rows.select(
        "*", normalised(F.col("_text")).alias("_norm"), F.length(F.coalesce("_text", F.lit(""))).alias("_chars"),
    ).select("_id", "_norm", "_chars", _keys(F.col("_norm"), F.col("_id"), F.col("_text")).alias("_key"))
    placed = keyed.select(
        "_id", "_norm", "_chars", F.col("_key.p").alias("_p"), F.col("_key.h").alias("_h"),
        _range_of(F.col("_key"), splitters).cast("int").alias("_bucket"),
    ).repartitionById(len(splitters) + 1, F.col("_bucket"))
    order = ["_p", "_h", "_norm", F.desc("_chars"), F.asc_nulls_last("_id")]
    along = W.partitionBy("_bucket").orderBy(*order)
    before = F.lag("_norm").over(along)
    marked = placed.withColumn("_head", before.isNull() | (before != F.col("_norm")))
    numbered = marked.withColumn(
        "_gnum", F.sum(F.col("_head").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0))
    )
    edge = F.col("_h").isin([*{h for _, h, _ in splitters}]) if splitters else F.lit(False)
    return numbered.select(
        "_id", "_chars", "_bucket", "_gnum", "_head", F.sha2("_norm", 256).alias("_sha"),
        edge.alias("_edge"), F.when(F.col("_head") & edge, F.col("_norm")).alias("_text"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group of every row by its text without whitespace.

    Returns doc_id, keep_id, group_size, kept and text_sha256. The row with the most code
    points stays, then the smallest doc_id; a null id comes last. Of rows that repeat an id
    and a text exactly one is kept. A null text counts as empty.
    """
    rows = store(_sorted_groups(docs, id_col, text_col), "content-sort")
    group = W.partitionBy("_bucket", "_gnum")
    best = group.orderBy(F.desc("_chars"), F.asc_nulls_last("_id"))
    local = rows.select(
        "_id", "_sha", "_bucket", "_gnum", "_edge",
        F.row_number().over(best).alias("_place"), F.first("_id").over(best).alias("_keep"),
        F.count(F.lit(1)).over(group).alias("_size"),
    )
    heads = rows.filter("_edge").groupBy("_bucket", "_gnum").agg(
        F.max("_text").alias("_text"), F.max("_chars").alias("_chars"), F.count(F.lit(1)).alias("_n"),
    )
    firsts = rows.filter("_head AND _edge").select("_bucket", "_gnum", F.col("_id").alias("_first"))
    parts = heads.join(firsts, ["_bucket", "_gnum"])
    whole = parts.groupBy("_text").agg(
        F.sum("_n").alias("_total"),
        F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_first").isNull().alias("n"), F.col("_first").alias("i"),
                       F.col("_bucket").alias("b"))).alias("_best"),
    )
    stitched = parts.select("_bucket", "_gnum", "_text").join(whole, "_text").select(
        "_bucket", "_gnum", "_total", F.col("_best.i").alias("_best_id"), F.col("_best.b").alias("_best_bucket")
    )
    merged = local.join(stitched, ["_bucket", "_gnum"], "left")
    return merged.select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_total").isNull(), F.col("_keep")).otherwise(F.col("_best_id")).alias("keep_id"),
        F.coalesce("_total", "_size").alias("group_size"),
        ((F.col("_place") == 1) & (F.col("_total").isNull() | (F.col("_bucket") == F.col("_best_bucket")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the documents that stay, with the size of the group each stands for."""
    return exact_duplicates(docs, id_col, text_col).filter("kept").select("doc_id", "group_size", "text_sha256")
