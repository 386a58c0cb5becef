"""Proportional stratified interleaving: shards of equal row counts that all match the mixture.

Rows are shuffled by a seeded hash and ranked within their source. A row's fractional rank,
(rank + start) / rows of the source, spreads each source evenly over (0, 1); the starts, evenly
spread over the sources, keep small sources from meeting at one place. Sorting all rows by
it and cutting the order into equal runs gives every shard the same share of each source up
to a row or two, and the same share of all small sources together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthline.llm.rows import bucket_count, sum_before, unit, with_row_key
from berthline.session import store

SEED = 42


def interleaved(rows: DataFrame, source: str, order: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with _shard and _slot. ``order`` tells rows apart; its hash is the shuffle."""
    buckets = bucket_count(rows)
    shuffled = store(
        rows.withColumn("_shuffle", F.xxhash64(F.lit(seed), *order))
        .withColumn("_hb", F.floor(unit(F.col("_shuffle")) * buckets).cast("int")),
        "shuffled",
    )
    sources = store(
        shuffled.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_sh", F.xxhash64(F.lit(seed + 1), "_s"))
        .withColumn("_sb", F.floor(unit(F.col("_sh")) * buckets).cast("int")),
        "sources",
    )
    # multiples of the golden ratio fill (0, 1) evenly however many there are
    start = F.pmod(F.col("_index") * F.lit(0.6180339887498949) + F.lit(0.5), F.lit(1.0))
    per_source = sum_before(sources, [], "_sb", ["_sh", "_s"], F.lit(1), "_index").select("_s", "_n", start.alias("_start"))
    ranked = sum_before(shuffled, [source], "_hb", ["_shuffle", *order], F.lit(1), "_rank")
    ranked = store(
        ranked.join(per_source, F.col(source).eqNullSafe(F.col("_s")))
        .withColumn("_fraction", (F.col("_rank") + F.col("_start")) / F.col("_n"))
        .withColumn("_fb", F.floor(F.col("_fraction") * buckets).cast("int"))
        .select(*shuffled.columns, "_fraction", "_fb"),
        "ranked",
    )
    total = max(ranked.count(), 1)
    placed = sum_before(ranked, [], "_fb", ["_fraction", source, "_shuffle", *order], F.lit(1), "_position")
    return (
        placed.withColumn("_shard", F.expr(f"cast((_position * {shards}L) div {total}L as int)"))
        .withColumn("_slot", F.expr(f"_position - (_shard * {total}L + {shards - 1}L) div {shards}L"))
        .select(*rows.columns, "_shard", "_slot")
    )


def shard_slots(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; ``law`` is `rows`.

    Shards differ by one row at most, slots run from 0 without a gap. Size is the text's
    UTF-8 bytes plus 1; a null text has no bytes and the checksum of an empty one. A null
    source is a source of its own. Rows that repeat an id and a text each get a slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleaved(rows, "source", ["doc_id", "text_crc32", "size"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, source_col: str = "source", shards: int = 16) -> DataFrame:
    """All rows of ``docs`` with shard and slot; columns of those names are replaced."""
    base = with_row_key(docs.drop("shard", "slot"))
    narrow = base.select("_row", "_copy", F.col(f"_doc.{source_col}").alias("_source"))
    placed = interleaved(narrow, "_source", ["_row", "_copy"], shards).select("_row", "_copy", "_shard", "_slot")
    return base.join(placed, ["_row", "_copy"]).select(
        "_doc.*", F.col("_shard").alias("shard"), F.col("_slot").alias("slot")
    )
