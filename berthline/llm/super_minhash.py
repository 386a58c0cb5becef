"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and grouping.

A document's set is its distinct k-word shingles. SuperMinHash gives every element one
permutation of the signature's places; the j-th place it visits gets the value j plus a
fraction, and a place keeps the smallest value it is given. Values of step j are all below
j + 1, so a set stops as soon as no place holds more than that: long texts need one or two
steps. Places of one signature are negatively correlated, which lowers the variance of the
estimate below that of independent hashes.

Documents that share a band are compared on their full sets. Where one comparison each does
not join a band's documents, which is so where many share a long passage, the rest are
compared if they share one of their rarest shingles, as similar sets must, and if bitmaps of
their sets leave it open whether they are similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthline.llm.grouping import apart, connected, first_links, join_links, with_ends
from berthline.llm.rows import keep_marked, packed, probably_in, small_batches, store_text
from berthline.llm.text import LOWER, NON_SPACE, mix, slices, word_hashes, words
from berthline.session import store

SHINGLE = 5
#: 24 bands of 6 rows miss a pair of similarity 0.85 with probability 1e-5.
BANDS, ROWS = 24, 6

#: Sets and elements in one block of a cluster.
BLOCK_SETS, BLOCK_ELEMENTS = 2048, 1_000_000
#: Members of a key that one task compares (of a crowded one, two blocks of them), bits of a set's bitmap at least
#: and at most (as powers of two).
KEY_MEMBERS, LEAST_BITS, MOST_BITS = 4096, 6, 16
#: Rows of keys and bytes of them that are looked at together, pairs that are listed together and bytes of their bitmaps.
KEY_ROWS, KEY_BYTES, PAIRS, PAIR_BYTES = 1 << 15, 1 << 25, 1 << 18, 1 << 24
#: Slots in which the frequency of shingles is counted for the texts that need a second look.
COUNTERS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FRACTION = np.uint64(56)
_MASK = (1 << 64) - 1


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each row.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text of fewer words than a
    shingle has one element, the whole sequence; a text without words has none.
    """
    for part in slices(column):
        data = LOWER[part.data]
        found = words(part, data, NON_SPACE)
        hashes = word_hashes(data, found)
        runs = np.zeros(0, dtype=np.uint64)
        if len(hashes) >= shingle:
            runs = np.full(len(hashes) - shingle + 1, np.uint64(shingle))
            for i in range(shingle):
                runs = runs * _STEP + hashes[i : len(hashes) - shingle + 1 + i]
            runs = mix(runs)
        for row in range(len(part)):
            low, high = found.at[row], found.at[row + 1]
            if high - low >= shingle:
                own = np.sort(runs[low : high - shingle + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif high > low:
                one = np.array([high - low], dtype=np.uint64)
                for h in hashes[low:high]:
                    one = one * _STEP + h
                yield mix(one)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signature of a non-empty set: ``size`` values, step in the top 8 bits."""
    result = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    places = None
    rows = np.arange(len(elements))
    for step in range(size):
        draw = mix(elements + np.uint64((step + 1) * int(_STEP) & _MASK))
        swap = step + ((draw >> np.uint64(32)) * np.uint64(size - step) >> np.uint64(32)).astype(np.int64)
        value = (mix(draw) >> np.uint64(8)) | (np.uint64(step) << _FRACTION)
        if step == 0:
            place, first = swap, swap
        else:
            if places is None:
                places = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
                places[:, 0] = first
                places[rows, first] = 0
            place = places[rows, swap]
            places[rows, swap] = places[:, step]
            places[:, step] = place
        np.minimum.at(result, place, value)
        if int(result.max()) < (step + 1) << int(_FRACTION):
            break
    return result


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different bands never sharing a key by design."""
    table = sign.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = mix(keys * _STEP + table[:, i])
    return keys.view(np.int64)


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, keys = [], [], []
            for own in shingle_sets(batch.column("_text"), shingle):
                n.append(len(own))
                if len(own):
                    nodes.append(f"{blake2b(own.tobytes(), digest_size=16).hexdigest()}{len(own):08x}")
                    keys.append(band_keys(signature(own, bands * rows), bands, rows))
                else:
                    nodes.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), pa.array(n, pa.int64()), pa.array(nodes, pa.string()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["_id", "_hash", "_n", "node", "_keys"],
            )

    return run


def _similar(shingle: int, similarity: tuple[int, int]):
    most, least = similarity[1], similarity[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_pylist()
            # rows come sorted by rep, so a set is built once for each stretch of equal reps
            heads = [i for i, r in enumerate(reps) if i == 0 or r != reps[i - 1]]
            sets = shingle_sets(batch.column("_rep_text").take(pa.array(heads, pa.int64())), shingle)
            first, other, keep = set(heads), None, []
            for i, own in enumerate(shingle_sets(batch.column("_text"), shingle)):
                if i in first:
                    other = next(sets)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(most * both >= least * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("rep")], ["node", "rep"]
            ).filter(pa.array(keep, pa.bool_()))

    return run


def _count_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for own in shingle_sets(batch.column("_text"), shingle):
                np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["slot", "n"])

    return run


def _prefixes(shingle: int, similarity: tuple[int, int], counters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counters.value
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            keys, owners = [np.zeros(0, dtype=np.int64)], []
            for i, own in enumerate(shingle_sets(batch.column("_text"), shingle)):
                size = len(own) - -(-similarity[0] * len(own) // similarity[1]) + 1
                order = np.lexsort((own, frequency[(own % np.uint64(COUNTERS)).astype(np.int64)]))
                keys.append(own[order[:size]].view(np.int64))
                owners += [nodes[i]] * size
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys), pa.int64()), pa.array(owners, pa.string())], ["key", "node"]
            )

    return run


def rare_shingles(texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(key, node): the rarest shingles of each text (node, _text), so many that two similar texts share one.

    Sets of a similarity share all but a small part of each, so their first shingles in any
    common order overlap. The order is by frequency, counted in COUNTERS slots: a passage
    that many texts have comes last, and only texts that are little else meet on it.
    """
    counted = texts.mapInArrow(_count_shingles(shingle), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # COUNTERS rows at most
    frequency = np.zeros(COUNTERS, dtype=np.int64)
    frequency[table["slot"].to_numpy(dtype=np.int64)] = table["n"].to_numpy(dtype=np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(frequency)
    return texts.select("node", "_text").mapInArrow(_prefixes(shingle, similarity, shared), "key bigint, node string")


def _several(buckets: DataFrame) -> DataFrame:
    """Rows (key, node; distinct) of the keys that more than one node has.

    Most keys have one node: those are ruled out where they are made, and only the rest is shuffled with its nodes.
    """
    shared = store(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("key"), "shared")
    kept = store(keep_marked(buckets, "key", shared, "key"), "kept")
    return with_ends(kept, "node").filter(F.col("_lo") != F.col("_hi")).select("key", "node")


def _forest(sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between similar sets, no more than it takes to join them; pairs are counted through shared elements."""
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    new = np.concatenate(([True], element[1:] != element[:-1])) if len(element) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(element)))
    group = np.cumsum(new) - 1
    by_owner = np.argsort(owner, kind="stable")
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    n = np.diff(at)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(sets)):
        own = group[by_owner[at[i] : at[i + 1]]]
        own = own[size[own] > 1]
        length = size[own]
        total = int(length.sum())
        if not total:
            continue
        place = np.repeat(start[own] - (np.cumsum(length) - length), length) + np.arange(total)
        both = np.bincount(owner[place], minlength=len(sets))
        both[: i + 1] = 0
        for j in np.flatnonzero(similarity[1] * both >= np.maximum(similarity[0] * (n[i] + n - both), 1)):
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                links.append((i, int(j)))
    return links


def _compare_block(shingle: int, similarity: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        links = _forest(list(shingle_sets(table.column("_text"), shingle)), similarity)
        return pa.table({
            "a": pa.array([nodes[i] for i, _ in links], pa.string()),
            "b": pa.array([nodes[j] for _, j in links], pa.string()),
        })

    return run


def set_bitmap(own: np.ndarray) -> bytes:
    """Slots that a set's elements fall into, by their low bits: two slots or more an element, up to MOST_BITS."""
    bits = min(max((2 * len(own) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    used = np.zeros(1 << bits, dtype=bool)
    used[(own & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(used, bitorder="little").tobytes()


def _bitmaps(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("_text"), shingle))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_bitmap(s) for s in sets], pa.binary())],
                ["node", "_n", "_bits"],
            )

    return run


def may_be_similar(
    group: np.ndarray, n: np.ndarray, bitmaps: list[bytes], similarity: tuple[int, int], wanted=lambda i, j: np.ones(len(i), dtype=bool)
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that may be similar by size and bitmap; no similar pair is left out.

    A slot that only one of two sets uses holds an element that the other lacks, which bounds what they share.
    Of bitmaps of two lengths the longer is folded. ``wanted`` tells which pairs are looked at.
    """
    level = np.array([len(b) for b in bitmaps], dtype=np.int64)
    order = np.lexsort((n, group))
    sized, owner = n[order], np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0)
    reach = int(n.max(initial=0)) + 1
    # sizes ascend in a group, so the sets that one is to be compared with are a stretch after it
    until = np.searchsorted(owner * reach + sized, owner * reach + np.minimum(sized * similarity[1] // similarity[0], reach - 1), side="right")
    ahead = np.cumsum(until - np.arange(len(order)) - 1)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in tables:
            at, rows = np.full(len(level), -1), []
            for longer in np.unique(level[level >= size]):
                mine = np.flatnonzero(level == longer)
                at[mine] = np.arange(len(mine)) + sum(len(r) for r in rows)
                words = np.frombuffer(b"".join(bitmaps[i] for i in mine), dtype=np.uint64)
                rows.append(np.bitwise_or.reduce(words.reshape(len(mine), -1, size // 8), axis=1))
            tables[size] = at, np.concatenate(rows)
        return tables[size]

    first = 0
    while first < len(order):
        done = int(ahead[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ahead, done + PAIRS, side="right")))
        count = np.diff(ahead[first:last], prepend=done)
        i = np.repeat(np.arange(first, last), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        first, i, j = last, order[i], order[j]
        keep = wanted(i, j)
        i, j = i[keep], j[keep]
        for size in np.unique(np.minimum(level[i], level[j])):
            own = np.flatnonzero(np.minimum(level[i], level[j]) == size)
            at, table = folded(int(size))
            step = max(1, PAIR_BYTES // int(size))
            for part in range(0, len(own), step):
                a, b = i[own[part : part + step]], j[own[part : part + step]]
                x, y = table[at[a]], table[at[b]]
                lacking = [np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((x, y), (y, x))]
                both = np.minimum(n[a] - lacking[0], n[b] - lacking[1])
                near = similarity[1] * both >= similarity[0] * (n[a] + n[b] - both)
                yield a[near], b[near]


def join_ends(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least item of each item's component so far, after links between the items a and b."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart_still = low != high
        if not apart_still.any():
            return label
        a, b = a[apart_still], b[apart_still]
        np.minimum.at(label, high[apart_still], low[apart_still])
        while not np.array_equal(label, further := label[label]):
            label = further


def _near_members(similarity: tuple[int, int]):
    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        named, comps = rows.column("node").dictionary_encode(), rows.column("comp").dictionary_encode()
        node, comp = (c.indices.to_numpy().astype(np.int64) for c in (named, comps))
        key, own, low, high, n = (rows.column(c).to_numpy() for c in ("key", "_own", "_i", "_j", "_n"))
        new = np.zeros(len(node), dtype=bool)
        for c in (key, low, high):
            new[1:] |= c[1:] != c[:-1]
        label = np.arange(len(named.dictionary))

        def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            # two blocks meet, or one with itself
            return (comp[i] != comp[j]) & ((low[i] == high[i]) | (own[i] != own[j])) & (label[node[i]] != label[node[j]])

        for i, j in may_be_similar(np.cumsum(new), n, rows.column("_bits").to_pylist(), similarity, wanted):
            label = join_ends(label, node[i], node[j])
        linked = np.flatnonzero(label != np.arange(len(label)))
        ends = [named.dictionary.take(pa.array(p)) for p in (linked, label[linked])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by key and block pair; a key's rows are looked at together
        held = None
        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None else batch
            if held.num_rows >= KEY_ROWS or held.nbytes >= KEY_BYTES:
                same = np.ones(held.num_rows, dtype=bool)
                for c in ("key", "_i", "_j"):
                    values = held.column(c).to_numpy()
                    same &= values == values[-1]
                cut = int(np.argmax(same))  # a key's rows are in one stretch
                if cut:
                    yield compare(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held)

    return run


def near_members(members: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links that join all ``members`` (key, node, comp) of one key and different components that may be similar.

    A task returns no more of them than it takes. Texts stay where they are: bitmaps of their sets go to the keys, a fraction of a text's size. Keys of more than KEY_MEMBERS
    members are dealt into blocks, each two of which meet in one task.
    """
    bitmaps = texts.select("node", "_text").mapInArrow(_bitmaps(shingle), "node string, _n bigint, _bits binary")
    whole = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / KEY_MEMBERS).cast("int").alias("_blocks"))
    crowded = whole.filter("_blocks > 1")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = members.join(crowded, "key", "left").select(
        "key", "node", "comp", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("_own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"),
    )
    met = dealt.join(bitmaps, "node").select(
        "key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own",
        *[F.unhex(c).alias(c) for c in ("node", "comp")], "_n", "_bits",
    )
    pairs = met.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").mapInArrow(
        _near_members(similarity), "a binary, b binary"
    )
    return pairs.select(*[F.lower(F.hex(c)).alias(c) for c in "ab"])


def _link_clusters(
    buckets: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int]
) -> DataFrame:
    """``labels`` after comparing all sets that share a bucket and may be similar.

    Nodes that such pairs connect form a cluster. A cluster is dealt into blocks of bounded
    size, and each two of its blocks are compared in one task, which counts shared elements and returns
    the links it takes to join the similar ones. Buckets alone connect more and more of a growing table,
    and the texts of a cluster are sent once for each of its blocks; so pairs are ruled out by bitmaps first.
    """
    clusters = connected(near_members(store(apart(buckets, labels), "apart"), texts, shingle, similarity))
    weight = F.conv(F.substring("node", 33, 8), 16, 10).cast("bigint")
    sizes = clusters.groupBy("comp").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum(weight) / BLOCK_ELEMENTS)).cast("int").alias("_blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("_blocks") - 1, F.lit(0))))
    dealt = (
        clusters.join(sizes, "comp").select("comp", "node", own.alias("_own"), other.alias("_other"))
        .select("comp", "node", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    )
    links = store(
        dealt.join(texts, "node").groupBy("comp", "_i", "_j").applyInArrow(
            _compare_block(shingle, similarity), "a string, b string"
        ),
        "links",
    )
    return join_links(labels, links)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: _id, _hash (of the text), _n (set size), node and _keys (of the bands).

    A node is a set's digest with its size; documents with equal sets have one node.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("_id", kind), T.StructField("_hash", T.LongType()), T.StructField("_n", T.LongType()),
        T.StructField("node", T.StringType()), T.StructField("_keys", T.ArrayType(T.LongType())),
    ])
    return docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), text_key(text_col).alias("_hash")
    ).select("_id", "_hash", "_text").mapInArrow(_sketch(shingle, bands, rows), schema)


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int], bands: int, rows: int
) -> DataFrame:
    """_id, _hash, _n, node, _group (smallest id of the component; the own id without words) and _best (its hash)."""
    with small_batches(docs.sparkSession):
        return _grouped_now(docs, id_col, text_col, shingle, similarity, bands, rows)


def _grouped_now(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int], bands: int, rows: int
) -> DataFrame:
    rows_of = store(sketches(docs, id_col, text_col, shingle, bands, rows), "sketches")
    nodes = store(
        rows_of.filter("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_hash")).alias("_first"),
            F.first("_keys").alias("_keys"),
        ).select("node", F.col("_first._id").alias("_id"), F.col("_first._hash").alias("_hash"), "_keys"),
        "nodes",
    )
    buckets = store(_several(nodes.select("node", F.explode("_keys").alias("key"))), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "_id", "_hash")
    source = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_text"), text_key(text_col).alias("_dhash"))
    texts = store_text(
        source.filter(probably_in(wanted, "_hash", "_dhash"))
        .join(wanted, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dhash") == F.col("_hash")))
        .groupBy("node").agg(F.first("_text").alias("_text")),
        "texts",
    )
    schema = T.StructType([T.StructField("node", T.StringType()), T.StructField("rep", T.StringType())])

    def verify(pairs: DataFrame) -> DataFrame:
        # a smaller set is at most all of the larger one: sizes are the last 8 digits of a node
        sizes = [F.conv(F.substring(c, 33, 8), 16, 10).cast("bigint") for c in ("node", "rep")]
        near = F.least(*sizes) * similarity[1] >= F.greatest(*sizes) * similarity[0]
        with_text = pairs.filter(near).join(texts, "node")
        reps = texts.select(F.col("node").alias("rep"), F.col("_text").alias("_rep_text"))
        return (
            with_text.join(reps, "rep").select("node", "rep", "_text", "_rep_text").sortWithinPartitions("rep")
            .mapInArrow(_similar(shingle, similarity), schema)
        )

    labels = first_links(buckets, verify)
    left = apart(buckets, labels).select("node").distinct()
    second = store(_several(rare_shingles(texts.join(left, "node"), shingle, similarity)), "rare")
    labels = _link_clusters(second, labels, texts, shingle, similarity)
    members = nodes.select("node", "_id", "_hash").join(labels, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")
    )
    smallest = members.groupBy("comp").agg(
        F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_hash")).alias("_first")
    )
    groups = members.join(smallest, "comp").select(
        "node", F.col("_first._id").alias("_group"), F.col("_first._hash").alias("_best")
    )
    alone = F.col("node").isNull()
    return rows_of.drop("_keys").join(groups, "node", "left").withColumns({
        "_group": F.when(alone, F.col("_id")).otherwise(F.col("_group")),
        "_best": F.when(alone, F.col("_hash")).otherwise(F.col("_best")),
    })


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    similarity: tuple[int, int] = (85, 100), bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if their sets' Jaccard similarity is at least the fraction
    ``similarity``. A component's id is its smallest document id. Null and empty texts
    have no set and are linked with nothing. Rows that repeat an id and a text share their
    result. A null id is never the smallest; a component of null ids only has a null id,
    and all its rows count as kept.
    """
    found = _grouped(docs, id_col, text_col, shingle, similarity, bands, rows)
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_group").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_group")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    similarity: tuple[int, int] = (80, 100), bands: int = 36, rows: int = 5,
) -> DataFrame:
    """The documents that stay, one of each component, with the columns of ``docs``.

    Of rows that repeat an id and a text one stays, the first by its other columns.
    Documents without words all stay.
    """
    found = _grouped(docs, id_col, text_col, shingle, similarity, bands, rows)
    stay = (
        found.filter(F.col("_id").eqNullSafe(F.col("_group")) & (F.col("_hash") == F.col("_best")))
        .groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"), F.max("node").alias("_node"))
        .withColumn("_single", (F.col("_rows") == 1) | F.col("_node").isNull())
    )
    stay = store(stay.select(F.col("_id").alias("_kid"), F.col("_hash").alias("_khash"), "_single"), "stay")
    named = docs.select(packed(docs), F.col(id_col).alias("_did"), text_key(text_col).alias("_dhash"))
    kept = named.join(stay, F.col("_did").eqNullSafe(F.col("_kid")) & (F.col("_dhash") == F.col("_khash")))
    single = kept.filter("_single").select("_doc.*")
    if stay.filter("NOT _single").isEmpty():
        return single
    order = W.partitionBy("_did", "_dhash").orderBy("_doc")
    first = kept.filter("NOT _single").withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    return single.unionByName(first.select("_doc.*"))
