"""Merkle manifest of documents: leaves appended to trees whose open subtrees carry partial witnesses.

Leaves are sorted by language and id and numbered there. Every 2^BLOCK_BITS consecutive leaves are one
aligned subtree, built by appending them one after the other: an appended leaf is an open
subtree, two open subtrees of one height complete each other, and on completion the witnesses
of all leaves below are extended by the digest of the other side. The root of a block
is then appended like a leaf to the tree of the blocks, level by level, until a language
has one root; the languages' roots form the last tree. A block's witness extends those
of its leaves, so a proof is put together from the parts of its levels, and no task ever
holds more than a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.session import store

#: Height of the subtree that one group of rows is appended to.
BLOCK_BITS = 12
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    """Digest of a document; ``changed`` replaces columns."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def _hash(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class WitnessTree:
    """Append-only tree of fixed capacity that keeps the witness of every leaf up to date.

    ``siblings[i, h]`` is the digest beside leaf i's ancestor of height h: empty until the
    other side is complete, and for ever where a node has none beside it.
    """

    def __init__(self, capacity: int, height: int):
        self.siblings = np.zeros((capacity, height), dtype="S64")
        self.open: list[tuple[int, int, bytes]] = []  # height, first leaf, digest; heights fall
        self.size = 0

    def append(self, leaf: bytes) -> None:
        self.open.append((0, self.size, leaf))
        self.size += 1
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._complete()

    def _complete(self) -> None:
        height, middle, right = self.open.pop()
        _, first, left = self.open.pop()
        self.siblings[first:middle, height] = right
        self.siblings[middle : self.size, height] = left
        self.open.append((height + 1, first, _hash(left, right)))

    def close(self, height: int) -> bytes:
        """Raise what is still open to one root of ``height``: a node without a neighbour is hashed alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._complete()
            else:
                h, first, node = self.open.pop()
                self.open.append((h + 1, first, _hash(node)))
        return self.open[0][2]


def _build(table: pa.Table, bits: int) -> tuple[WitnessTree, np.ndarray, int]:
    """The tree of one block (_at, _node, _count), the order of its rows, and its height.

    A tree that goes on beyond the block is closed at the block's height; a whole one at its own.
    """
    at = table.column("_at").to_numpy()
    order = np.argsort(at)
    count = table.column("_count")[0].as_py()
    height = bits if count > 1 << bits else (count - 1).bit_length()
    tree = WitnessTree(len(at), height)
    nodes = table.column("_node").combine_chunks().take(pa.array(order)).cast(pa.binary()).to_pylist()
    for node in nodes:
        tree.append(node)
    return tree, order, height


def _block_root(table: pa.Table, bits: int) -> pa.Table:
    """The root of a block as a node of the next level."""
    tree, _, height = _build(table, bits)
    first = table.slice(0, 1).select(["_tree", "_block", "_count"]).to_pydict()
    return pa.table({
        "_tree": pa.array(first["_tree"], pa.int64()), "_block": pa.array(first["_block"], pa.int64()),
        "_node": pa.array([tree.close(height).decode()], pa.string()),
        "_count": pa.array([-(-first["_count"][0] >> bits)], pa.int64()),
    })


def _steps(tree: WitnessTree, at: np.ndarray, height: int) -> pa.ListArray:
    """Steps of the leaves at ``at`` (order of the tree) up to the block's root."""
    sides = np.zeros((2, len(at), height), dtype="S64")
    odd = ((at[:, None] >> np.arange(height)) & 1).astype(bool)
    sides[0][odd], sides[1][~odd] = tree.siblings[odd], tree.siblings[~odd]
    left, right = (
        pc.if_else(pa.array(s.ravel() == b""), pa.scalar(None, pa.string()), pa.array(s.ravel().tolist(), pa.binary()).cast(pa.string()))
        for s in sides
    )
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(at) + 1) * height, pa.int32()), pa.StructArray.from_arrays([left, right], ["left", "right"])
    )


def _with_witness(nodes: pa.Table, above: pa.Table, bits: int) -> pa.Table:
    """Rows of a block with _proof: the steps inside the block, then those that ``above`` (one row) has for it."""
    tree, order, height = _build(nodes, bits)
    tree.close(height)
    rows = nodes.take(pa.array(order))
    beyond = above.column("_proof").combine_chunks()
    own = _steps(tree, rows.column("_at").to_numpy(), height)
    further = len(beyond.flatten())
    n, width = len(order), height + further
    flat = pa.concat_arrays([own.flatten(), beyond.flatten()])
    picks = np.empty((n, width), dtype=np.int64)
    picks[:, :height] = np.arange(n * height).reshape(n, height)
    picks[:, height:] = n * height + np.arange(further)
    proofs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat.take(pa.array(picks.ravel())))
    sub = pa.array([above.column("_sub")[0].as_py()] * n, pa.string())
    return rows.append_column("_proof", proofs).append_column("_sub", sub)


def _levels(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tables of nodes (_tree, _at, _block, _node, _count), each one the block roots of the one before.

    The last one has the root of each tree.
    """
    levels = [nodes]
    while True:
        blocks = levels[-1].select("_tree", "_at", "_block", "_node", "_count").groupBy("_tree", "_block")
        roots = store(
            blocks.applyInArrow(
                lambda block: _block_root(block, bits), "_tree bigint, _block bigint, _node string, _count bigint"
            ).select("_tree", F.col("_block").alias("_at"), F.shiftright("_block", bits).alias("_block"), "_node", "_count"),
            "merkle-level",
        )
        levels.append(roots)
        if roots.filter("_count > 1").isEmpty():
            return levels


def _proofs(levels: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The first level with _proof, the steps to the root of everything, and _sub.

    ``above`` (_tree, _proof, _sub) has the steps from the root of each tree on, and a text for all of its leaves.
    """
    known = above.select("_tree", F.lit(0).cast("bigint").alias("_block"), "_proof", "_sub")
    for n, level in reversed(list(enumerate(levels[:-1]))):
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in level.schema) + f", _proof {PROOF}, _sub string"
        pairs = level.groupBy("_tree", "_block").cogroup(known.groupBy("_tree", "_block"))
        steps = pairs.applyInArrow(lambda nodes, beyond: _with_witness(nodes, beyond, bits), schema)
        if n:
            known = store(steps.select("_tree", F.col("_at").alias("_block"), "_proof", "_sub"), "merkle-witness")
    return steps


def _numbered(docs: DataFrame, extra: list[Column], bits: int) -> DataFrame:
    """Leaves with their tree, place and block, and the size of the tree.

    Rows are range-partitioned by (lang, doc_id, digest, row), so a task never holds more than a
    range. A place is a row's number in its range plus the rows of the ranges before; trees are
    numbered like that as well, by the ranges in which they begin.
    """
    spark = docs.sparkSession
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("_node"), F.col("_tie")]
    leaves = docs.select("lang", "doc_id", leaf_digest().alias("_node"), *extra, F.monotonically_increasing_id().alias("_tie"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    rows = store(ranged.withColumn("_seq", F.monotonically_increasing_id()), "merkle-leaves")  # numbers rows in their range
    part, inside = F.shiftright("_seq", 33).alias("_part"), F.col("_seq").bitwiseAND((1 << 33) - 1).alias("_in")
    numbered = rows.select("*", part, inside)
    ranges = store(
        numbered.groupBy("_part", "lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_least")), "merkle-ranges"
    )
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier.partitionBy("lang")), F.lit(0)) - F.col("_least")
    places = ranges.select("_part", "lang", shift.alias("_shift"))
    trees = ranges.groupBy("lang").agg(F.sum("_n").alias("_count"), F.min("_part").alias("_begin"))
    begun = trees.groupBy(F.col("_begin").alias("_part")).agg(F.count(F.lit(1)).alias("_t"))  # one row a range
    base = begun.select(F.col("_part").alias("_begin"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    among = F.row_number().over(W.partitionBy("_begin").orderBy(F.col("lang").asc_nulls_first())) - 1
    named = trees.join(base, "_begin").select("lang", (F.col("_base") + among).alias("_tree"), "_count")
    known = store(
        places.alias("p").join(named.alias("t"), F.col("p.lang").eqNullSafe(F.col("t.lang")))
        .select(F.col("_part").alias("_p"), F.col("p.lang").alias("_l"), "_shift", "_tree", "_count"),
        "merkle-trees",
    )
    at = F.col("_in") + F.col("_shift")
    return store(
        numbered.join(known, (F.col("_part") == F.col("_p")) & F.col("lang").eqNullSafe(F.col("_l"))).select(
            "_tree", at.alias("_at"), F.shiftright(at, bits).alias("_block"), "_node", "_count",
            *[c for c in rows.columns if c not in ("lang", "_node", "_seq")],
        ),
        "merkle-placed",
    )


def manifest(docs: DataFrame, extra: list[Column] | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Every document's leaf and its proof up to one root over all languages.

    Returns doc_id, leaf, subroot (of the language), root, proof (an array of steps with
    ``left`` and ``right``: the digest beside the path, both null where a node is hashed
    alone) and the columns ``extra`` of ``docs``. ``fold`` leads from leaf and proof to the
    root. Leaves ascend by doc_id, null first, rows that repeat an id by digest. A null
    language is a tree of its own, before the others; a null field is hashed as `-`, an empty
    one as `0:`. A lone document is its own subroot, a lone language's subroot the root. No
    documents, no rows. Columns that are not hashed are ignored.
    """
    extra = [c.alias(f"_extra{i}") for i, c in enumerate(extra or [])]
    levels = _levels(_numbered(docs, extra, block_bits), block_bits)
    trees = levels[-1].count()
    tops = _levels(store(levels[-1].select(
        F.lit(0).cast("bigint").alias("_tree"), F.col("_tree").alias("_at"),
        F.shiftright("_tree", block_bits).alias("_block"), "_node", F.lit(trees).cast("bigint").alias("_count"),
    ), "merkle-subroots"), block_bits)
    root = tops[-1].first()
    ends = tops[-1].select("_tree", F.array().cast(PROOF).alias("_proof"), F.lit(None).cast("string").alias("_sub"))
    steps = _proofs(tops, ends, block_bits).select(F.col("_at").alias("_tree"), "_proof", F.col("_node").alias("_sub"))
    return _proofs(levels, store(steps, "merkle-witness"), block_bits).select(
        "doc_id", F.col("_node").alias("leaf"), F.col("_sub").alias("subroot"),
        F.lit(root and root["_node"]).cast("string").alias("root"), F.col("_proof").alias("proof"),
        *[f"_extra{i}" for i in range(len(extra))],
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root to which a leaf and its proof lead."""
    return F.aggregate(
        proof, leaf,
        lambda node, s: digest(F.coalesce(s["left"], F.lit("")), node, F.coalesce(s["right"], F.lit(""))),
    )


def siblings(proof: Column) -> Column:
    """The digests of a proof from the leaf to the root as one text."""
    return F.concat_ws("", F.transform(proof, lambda s: F.coalesce(s["left"], s["right"])))


def audit(docs: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The manifest with the digest of every proof, and what it finds in documents that were tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. Where 7 divides
    the CRC-32 of the decimal doc_id, folded_root starts from the leaf of a document whose n_chars
    is one larger; a null n_chars stays, and a null doc_id is not tampered with.
    """
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    changed = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(n_chars=F.col("n_chars") + 1))
    proofs = manifest(docs, [changed], block_bits).withColumnRenamed("_extra0", "_changed")
    folded = proofs.withColumn("folded_root", fold(F.coalesce("_changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

