"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a stretch of documents in one task. Its words become numbers (0 for a word that
no benchmark item has, which also ends every match), and its suffixes are sorted by
doubling ranks to the depth of a window. Every suffix of an item that holds a whole window is
looked up by binary search: the run of suffixes that share its window gives all places where the
window occurs, and each match is followed to its end. Items of equal words are looked up once.
The benchmark reaches the tasks in blocks of bounded size, one stored pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthline.llm.rows import packed, store_text
from berthline.llm.text import ALPHANUMERIC, LOWER, Slice, Words, slices, word_hashes, words

WINDOW = 10
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 16 << 20
#: Bytes of training text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20


@dataclass
class Benchmark:
    """A block of items of different words: the ids of each, and its words as numbers (1 upwards), one item after the other."""

    ids: list[list[str]]
    vocabulary: np.ndarray
    tokens: np.ndarray
    at: np.ndarray
    window: int

    @property
    def shortest(self) -> int:
        return int(min(self.window, np.diff(self.at).min()))

    @property
    def longest(self) -> int:
        return int(np.diff(self.at).max())


def _number(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary, from 1; 0 for the others."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int32)
    near = np.searchsorted(vocabulary, hashes)
    near[near == len(vocabulary)] = 0
    return np.where(vocabulary[near] == hashes, near + 1, 0).astype(np.int32)


def benchmark_block(ids: list[str | None], texts: list[str], window: int = WINDOW) -> Benchmark | None:
    """None if no item has a word. A null id counts for matches and is not listed."""
    hashes: list[np.ndarray] = []
    for part in slices(pa.array(texts, pa.large_string())):
        data = LOWER[part.data]
        found = words(part, data, ALPHANUMERIC)
        own = word_hashes(data, found)
        hashes += [own[a:b] for a, b in zip(found.at[:-1], found.at[1:], strict=True)]
    alike: dict[bytes, tuple[np.ndarray, list[str]]] = {}
    for i, h in zip(ids, hashes, strict=True):
        if len(h):
            alike.setdefault(h.tobytes(), (h, []))[1].extend([] if i is None else [i])
    if not alike:
        return None
    full = [h for h, _ in alike.values()]
    joined = np.concatenate(full)
    vocabulary = np.unique(joined)
    at = np.concatenate(([0], np.cumsum([len(h) for h in full])))
    return Benchmark([sorted(set(own)) for _, own in alike.values()], vocabulary, _number(joined, vocabulary), at, window)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that begin with a word number, sorted by their first ``depth`` words at least.

    A 0 ends a suffix. Each round doubles the words that ranks stand for.
    """
    place = np.flatnonzero(tokens)
    rank = np.append(tokens, 0).astype(np.int64)
    order = np.argsort(rank[place], kind="stable")
    done = 1
    while done < depth and len(place):
        key = rank[place] * (rank.max() + 1) + rank[np.minimum(place + done, len(tokens))]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[place[order]] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        done *= 2
    return place[order]


def _heads(tokens: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` words of each suffix as bytes that compare like the words; nothing follows a 0."""
    if not len(start):
        return np.zeros(0, dtype=f"S{4 * width}")
    padded = np.append(tokens, np.zeros(width, dtype=np.int32))
    block = padded[start[:, None] + np.arange(width)]
    block *= np.minimum.accumulate(block != 0, axis=1)
    return np.ascontiguousarray(block.astype(">u4")).view(f"S{4 * width}").reshape(-1)


def _shard_tokens(found: Words, numbers: np.ndarray, rows: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with a 0 after each row, and where each row starts.

    A stretch of benchmark words shorter than the shortest window holds none and is blanked.
    """
    counts = np.diff(found.at)
    first = found.at[:-1] + np.arange(rows)
    tokens = np.zeros(len(numbers) + rows + 1, dtype=np.int32)
    tokens[np.arange(len(numbers)) + np.repeat(np.arange(rows), counts)] = numbers
    filled = np.concatenate(([0], (tokens != 0).astype(np.int8), [0]))
    change = np.diff(filled)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    brief = ends - starts < shortest
    if brief.any():
        step = np.zeros(len(tokens) + 1, dtype=np.int32)
        step[starts[brief]] += 1
        step[ends[brief]] -= 1
        tokens[np.cumsum(step[:-1]) > 0] = 0
    return tokens, first


@dataclass
class Matches:
    """Occurrences of item suffixes in a shard: row and word of the row, item and word of the item, matching words."""

    row: np.ndarray
    at: np.ndarray
    item: np.ndarray
    item_at: np.ndarray
    length: np.ndarray
    window: np.ndarray


def find_matches(bench: Benchmark, part: Slice) -> tuple[Matches, Words]:
    """All places in a shard that share a window with an item, by binary search for each of its suffixes."""
    data = LOWER[part.data]
    found = words(part, data, ALPHANUMERIC)
    numbers = _number(word_hashes(data, found), bench.vocabulary)
    tokens, first = _shard_tokens(found, numbers, len(part), bench.shortest)
    array = suffix_array(tokens, bench.window)
    size = np.diff(bench.at)
    item = np.repeat(np.arange(len(size)), size)
    item_at = np.arange(len(bench.tokens)) - bench.at[item]
    window = np.minimum(size, bench.window)[item]
    queries = np.flatnonzero(size[item] - item_at >= window)
    # words of the next item do not belong to a suffix: items are separated like rows are
    apart = np.zeros(len(bench.tokens) + len(size), dtype=np.int32)
    shifted = np.arange(len(bench.tokens)) + item
    apart[shifted] = bench.tokens
    low_key = _heads(apart, shifted[queries], bench.window)
    high_key = low_key.view(">u4").reshape(len(queries), -1).copy()
    high_key[np.arange(bench.window) >= window[queries][:, None]] = 0xFFFFFFFF
    high_key = np.ascontiguousarray(high_key).view(f"S{4 * bench.window}").reshape(-1)
    heads = _heads(tokens, array, bench.window)
    low, high = np.searchsorted(heads, low_key, "left"), np.searchsorted(heads, high_key, "right")
    hits = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(queries)), hits)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
    place = array[low[which] + inside]
    query = queries[which]
    length = window[query].copy()
    going = np.arange(len(place))
    while len(going):
        a, b = place[going] + length[going], shifted[query[going]] + length[going]
        same = (b < len(apart)) & (a < len(tokens))
        same[same] = (tokens[a[same]] == apart[b[same]]) & (tokens[a[same]] != 0)
        going = going[same]
        length[going] += 1
    row = np.searchsorted(first, place, side="right") - 1
    return Matches(row, place - first[row], item[query], item_at[query], length, window[query]), found


_ADDED = ("_n_words", "_hits", "_n_hit", "_items", "_longest", "_longest_at", "_longest_item")


def _pass(bench, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark | None = bench.value
        for batch in batches:
            rows = batch.num_rows
            if first:
                n_words, hits, items = [0] * rows, [None] * rows, [[] for _ in range(rows)]
                longest, longest_at, longest_item = [0] * rows, [None] * rows, [None] * rows
            else:
                n_words, hits, _, items, longest, longest_at, longest_item = (
                    batch.column(c).to_pylist() for c in _ADDED
                )
            for part in slices(batch.column("_text"), SHARD_BYTES):
                if block is None:
                    found = words(part, LOWER[part.data], ALPHANUMERIC)
                else:
                    match, found = find_matches(block, part)
                counts = np.diff(found.at)
                n_words[part.first_row : part.first_row + len(part)] = counts.tolist()
                if block is None or not len(match.row):
                    continue
                order = np.argsort(match.row, kind="stable")
                edges = np.flatnonzero(np.diff(match.row[order], prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                    own = order[a:b]
                    local = int(match.row[own[0]])
                    i = part.first_row + local
                    n = int(counts[local])
                    step = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(step, match.at[own], 1)
                    np.add.at(step, match.at[own] + match.window[own], -1)
                    hit = np.cumsum(step[:-1]) > 0
                    if hits[i] is not None:
                        hit |= np.unpackbits(np.frombuffer(hits[i], dtype=np.uint8), count=n).astype(bool)
                    hits[i] = np.packbits(hit).tobytes()
                    items[i] = sorted({*items[i], *(name for k in np.unique(match.item[own]) for name in block.ids[k])})
                    best = own[np.lexsort((match.item_at[own], match.item[own], match.at[own], -match.length[own]))[0]]
                    if match.length[best] > longest[i]:
                        longest[i], longest_at[i] = int(match.length[best]), int(match.at[best])
                        longest_item[i] = next(iter(block.ids[match.item[best]]), None)
            n_hit = [int(np.bitwise_count(np.frombuffer(h, dtype=np.uint8)).sum()) if h else 0 for h in hits]
            columns = [
                pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()),
                pa.array(longest_at, pa.int64()), pa.array(longest_item, pa.string()),
            ]
            names = [c for c in batch.schema.names if c not in _ADDED]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *_ADDED])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Benchmark | None]:
    """The benchmark in blocks of about BLOCK_BYTES; items without a text are left out."""
    ids, texts, size = [], [], 0
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter(
        "t IS NOT NULL"
    )
    for row in items.orderBy("i", "t").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t.encode())
        if size >= BLOCK_BYTES:
            yield benchmark_block(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield benchmark_block(ids, texts, window)


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """_doc (all columns of ``docs``), _text, and what the benchmark shares with each text.

    _n_words; _hits and _n_hit: the words inside an occurrence of a window, as bits and as a
    count; _items: ids of the items with such windows, sorted; _longest, _longest_at and
    _longest_item: words, start and item of the longest verbatim match. A window is
    ``window`` consecutive words of an item, or all of a shorter item. Null texts have no
    words; items without words match nothing; the windows of an item without an id count like others,
    but the item is not listed.
    """
    schema = T.StructType([
        T.StructField("_doc", docs.schema), T.StructField("_text", T.StringType()), T.StructField("_n_words", T.LongType()),
        T.StructField("_hits", T.BinaryType()), T.StructField("_n_hit", T.LongType()),
        T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_longest", T.LongType()),
        T.StructField("_longest_at", T.LongType()), T.StructField("_longest_item", T.StringType()),
    ])
    context = docs.sparkSession.sparkContext
    result, block = docs.select(packed(docs), F.col(text_col).alias("_text")), None
    for following in _blocks(benchmark, item_col, item_text_col, window):
        if following is None:
            continue
        if block is not None:
            # at most a block of the benchmark at a time, BLOCK_BYTES and one item
            result = store_text(result, "decontamination")
            block.unpersist()
        first, block = block is None, context.broadcast(following)
        result = result.mapInArrow(_pass(block, first), schema)
    if block is None:
        result = result.mapInArrow(_pass(context.broadcast(None), True), schema)
    return result


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match of every row."""
    found = match_benchmark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    return found.select(
        "_doc.doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"), items_digest(F.col("_items")).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"), F.col("_longest").alias("longest"),
        F.col("_longest_at").alias("longest_at"), F.col("_longest_item").alias("longest_item"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with their columns."""
    return match_benchmark(docs, benchmark, text_col).filter("_n_hit = 0").select("_doc.*")
