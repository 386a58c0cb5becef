"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, served again from its start
when it ends. A document's virtual finish time is the words its queue has sent up to its
end, divided by the queue's target. Serving all queues in the order of finish times gives
each source its target's share at every moment; the service ends at the total budget.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.llm.rows import bucket_count, sum_before, unit, with_row_key
from berthline.llm.text import NON_SPACE, slices, words
from berthline.session import store

SEED = 7
#: Weights dealt to the sources in the order of their names.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the corpus.
SHARE = 1.5
#: A document is served this often at most.
EPOCHS = 2


def _count(column: pa.Array) -> pa.Array:
    out = []
    for part in slices(column):
        at = words(part, part.data, NON_SPACE).at
        out.extend((at[1:] - at[:-1]).tolist())
    return pa.array(out, pa.int64())


def word_count(text: str):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; a null has none."""

    @F.arrow_udf("bigint")
    def counted(column: pa.Array) -> pa.Array:
        return _count(column)

    return counted(F.col(text))


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """``sizes`` (_source, _total) with _target.

    Targets are proportional to the weights but end at ``epochs`` times a source's size;
    what is over goes to the others by weight. With sources in the order of limit / weight,
    the ones that end at their limit come first, so one pass finds the level of the rest.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("_source"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_weight", F.get(table, (F.row_number().over(order) - 1) % len(weights)))
    weighed = weighed.withColumn("_limit", F.col("_total").cast("double") * epochs)
    every = W.partitionBy(F.lit(0))
    along = every.orderBy(F.col("_limit") / F.col("_weight"), F.asc_nulls_last("_source"))
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    level = weighed.withColumn("_budget", F.sum("_total").over(every) * F.lit(float(share))).withColumn(
        "_level",
        (F.col("_budget") - (F.sum("_limit").over(upto) - F.col("_limit")))
        / (F.sum("_weight").over(every) - (F.sum("_weight").over(upto) - F.col("_weight"))),
    )
    full = F.col("_level") * F.col("_weight") > F.col("_limit")
    rest = F.max(F.when(~full, F.col("_level"))).over(every)
    return level.withColumn("_target", F.when(full, F.col("_limit")).otherwise(rest * F.col("_weight"))).select(
        "_source", "_total", "_target"
    )


def queued(
    rows: DataFrame, order: list[str], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS,
    epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``rows`` (_source, _size and the columns of ``order``, which tell rows apart) with _total, _target, _turns."""
    buckets = bucket_count(rows)
    shuffled = store(
        rows.withColumn("_shuffle", F.xxhash64(F.lit(seed), *order))
        .withColumn("_hb", F.floor(unit(F.col("_shuffle")) * buckets).cast("int")),
        "shuffled",
    )
    targets = source_targets(
        shuffled.groupBy("_source").agg(F.sum("_size").alias("_total")), share, weights, epochs
    ).select(F.col("_source").alias("_s"), "_total", "_target")
    sent = sum_before(shuffled, ["_source"], "_hb", ["_shuffle", *order], F.col("_size"), "_sent")
    queue = store(
        sent.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).select(
            *rows.columns, "_shuffle", "_total", "_target", (F.col("_sent") + F.col("_size")).alias("_sent")
        ),
        "queue",
    )
    turn = [(F.col("_sent") + F.col("_total") * e) / F.col("_target") for e in range(epochs)]
    budget = queue.agg((F.sum("_size") * F.lit(float(share))).alias("b")).first().b or 0.0
    served = queue.filter("_size > 0 AND _target > 0").select(
        "_source", "_size", "_shuffle", F.explode(F.array(*turn)).alias("_finish")
    )
    cut = _cut(served, budget, buckets)
    turns = F.lit(0)
    if cut is not None:
        last = _service(F.lit(cut[0]), F.lit(cut[1]).cast("string"), F.lit(cut[2]).cast("bigint"))
        for t in turn:
            served_now = (F.col("_size") > 0) & (_service(t, F.col("_source"), F.col("_shuffle")) <= last)
            turns = turns + F.when(served_now, 1).otherwise(0)
    return queue.select(*rows.columns, "_total", "_target", turns.alias("_turns"))


def _service(finish: Column, source: Column, shuffle: Column) -> Column:
    return F.struct(finish.alias("f"), source.alias("s"), shuffle.alias("h"))


def _cut(served: DataFrame, budget: float, buckets: int) -> tuple | None:
    """Key (finish, source, shuffle) of the last service inside the budget, if there is any.

    Finish times of what fits end near 1, as all targets together are the budget. Services
    are summed in narrow ranges of finish times; only the range in which the budget ends is put in
    order. The limit on the ranges doubles in the case that they do not fill the budget.
    """
    limit = 1.0 + 1.0 / 16
    top = served.agg(F.max("_finish").alias("m")).first().m
    while top is not None:
        near = served.filter(F.col("_finish") <= limit).withColumn("_fb", F.floor(F.col("_finish") * buckets))
        upto = W.partitionBy(F.lit(0)).orderBy("_fb").rowsBetween(W.unboundedPreceding, 0)
        sums = near.groupBy("_fb").agg(F.sum("_size").alias("_sum")).withColumn("_upto", F.sum("_sum").over(upto))
        over = sums.filter(F.col("_upto") > budget).agg(F.min(F.struct("_fb", "_upto", "_sum")).alias("r")).first().r
        if over is None and limit < top:
            limit *= 2
            continue
        if over is None:
            ends = near.agg(F.max(F.struct("_finish", "_source", "_shuffle")).alias("r")).first().r
            return tuple(ends) if ends else None
        inside = W.partitionBy(F.lit(0)).orderBy("_finish", "_source", "_shuffle").rowsBetween(W.unboundedPreceding, 0)
        fits = (
            near.filter(F.col("_fb") == over._fb)
            .withColumn("_upto", F.sum("_size").over(inside) + F.lit(over._upto - over._sum))
            .filter(F.col("_upto") <= budget)
        )
        ends = fits.agg(F.max(F.struct("_finish", "_source", "_shuffle")).alias("r")).first().r
        if ends is None:
            ends = near.filter(F.col("_fb") < over._fb).agg(
                F.max(F.struct("_finish", "_source", "_shuffle")).alias("r")
            ).first().r
        return tuple(ends) if ends else None
    return None


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS,
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    Size is a text's words (a null has none), taken the words the mix takes of it, repeats
    counted. A null source is a source of its own, the last one. Rows that repeat an id and
    a text are separate documents.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"),
        F.xxhash64(text_col).alias("_hash"),
    )
    return queued(rows, ["_id", "_hash", "_size"], share, weights, epochs).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_turns")).alias("taken"),
    )


def mix_documents(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", share: float = SHARE,
    weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS,
) -> DataFrame:
    """The rows of ``docs`` that the mix serves, each as often as it is served, with the columns of ``docs``.

    Documents without words take nothing of the budget and stay once.
    """
    base = with_row_key(docs)
    rows = base.select(
        "_row", "_copy", F.col(f"_doc.{source_col}").alias("_source"), word_count(f"_doc.{text_col}").alias("_size")
    )
    turns = queued(rows, ["_row", "_copy"], share, weights, epochs).select(
        "_row", "_copy", F.when(F.col("_size") == 0, 1).otherwise(F.col("_turns")).alias("_turns")
    ).filter("_turns > 0")
    served = base.join(turns, ["_row", "_copy"]).select("_doc", F.explode(F.sequence(F.lit(1), F.col("_turns"))))
    return served.select("_doc.*")
