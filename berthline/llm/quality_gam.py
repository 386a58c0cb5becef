"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into bins. Boosting visits the features in turn; each visit fits a
tree of a few leaves on one feature to the gradient of the log loss and adds it to that
feature's lookup table. The strongest pairs of features then get tables of their own the
same way. A score is the sum of one entry per table, so scoring is bin look-ups and additions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berthline.llm.rows import unit
from berthline.llm.text import slices, word_hashes, words

#: Most labelled rows that a fit uses, drawn by a hash of the id.
MAX_FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
SEED = 11

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "shouts_per_word",
    "distinct_words", "top_word", "repeated_lines", "lines_per_word", "line_length", "short_words", "long_words",
    "beyond_ascii", "repeated_runs", "space_share",
)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for a, b in ranges:
        table[a : b + 1] = 1
    return table


_SPACE = _class((9, 13), (32, 32))
_UPPER, _LOWER, _DIGIT = _class((65, 90)), _class((97, 122)), _class((48, 57))
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[[ord(c) for c in "#$%&*@^~|\\<>{}[]=+_/`"]] = 1
_MARK = np.zeros(256, dtype=np.uint8)
_MARK[[ord(c) for c in ".,;:!?\"'()-"]] = 1
_BEYOND = _class((128, 191))


def _repeats(values: np.ndarray) -> tuple[float, float]:
    """Share of values that occurred before, and share of the most frequent one."""
    if not len(values):
        return 0.0, 0.0
    ordered = np.sort(values)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(starts, len(ordered)))
    return 1 - len(starts) / len(values), float(sizes.max()) / len(values)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all zero for null and empty texts."""
    result = np.zeros((len(column), len(FEATURES)))
    in_line = np.ones(256, dtype=bool)
    in_line[10] = False
    for part in slices(column):
        if not len(part.data):
            continue
        data = part.data
        sums = {}
        for name, table in (("space", _SPACE), ("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT),
                            ("symbol", _SYMBOL), ("mark", _MARK), ("beyond", _BEYOND)):
            total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            sums[name] = total[part.bounds[1:]] - total[part.bounds[:-1]]
        shouts = np.concatenate(([0], np.cumsum(data == 33, dtype=np.int64)))
        shouts = shouts[part.bounds[1:]] - shouts[part.bounds[:-1]]
        found = words(part, data, _SPACE == 0)
        hashes = word_hashes(data, found)
        runs = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
        lengths = (found.end - found.start).astype(float)
        lines = words(part, data, in_line)
        line_hashes = word_hashes(data, lines)
        for i in range(len(part)):
            low, high = found.at[i], found.at[i + 1]
            n = int(high - low)
            if not n:
                continue
            size = float(part.bounds[i + 1] - part.bounds[i])
            solid = max(size - sums["space"][i], 1.0)
            letters = max(float(sums["upper"][i] + sums["lower"][i]), 1.0)
            own = lengths[low:high]
            first, last = lines.at[i], lines.at[i + 1]
            again, top = _repeats(hashes[low:high])
            result[part.first_row + i] = (
                np.log1p(n), own.mean(), sums["upper"][i] / letters, sums["digit"][i] / solid,
                sums["symbol"][i] / solid, sums["mark"][i] / solid, shouts[i] / n, 1 - again, top,
                _repeats(line_hashes[first:last])[0], (last - first) / n, np.log1p(size / max(last - first, 1)),
                (own <= 2).mean(), (own >= 13).mean(), sums["beyond"][i] / solid,
                _repeats(runs[low : high - 2])[0] if n > 2 else 0.0, sums["space"][i] / size,
            )
    return result


@dataclass
class GamModel:
    """Bin edges, one table per feature, and tables of feature pairs over coarser bins."""

    intercept: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                           np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of a histogram (bins below it go left) and its gain."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    best = int(np.argmax(gain))
    return best + 1, float(gain[best])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values per bin of a tree on one feature, grown leaf by leaf at the best gain."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_split(g[a:b], h[a:b])[::-1], a, b) for a, b in parts]
        gain, cut, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    value = np.zeros(len(g))
    for a, b in parts:
        value[a:b] = _step(g[a:b].sum(), h[a:b].sum())
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree that cuts one feature and then both sides on the other; the better order of the two."""
    best, best_gain = np.zeros(g.shape), 0.0
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            value, gain = np.zeros(gg.shape), -gg.sum() ** 2 / (hh.sum() + 1)
            for a, b in ((0, cut), (cut, gg.shape[0])):
                side_g, side_h = gg[a:b].sum(axis=0), hh[a:b].sum(axis=0)
                k, _ = _split(side_g, side_h)
                for c, d in ((0, k), (k, gg.shape[1])):
                    sg, sh = side_g[c:d].sum(), side_h[c:d].sum()
                    value[a:b, c:d] = _step(sg, sh)
                    gain += sg**2 / (sh + 1)
            if gain > best_gain:
                best, best_gain = (value.T if flip else value), gain
    return best, best_gain


def fit_gam(x: np.ndarray, y: np.ndarray) -> GamModel:
    """Cyclic boosting of single features, then of the PAIRS strongest pairs. Without rows, an even score."""
    n, k = x.shape
    rate = (y.sum() + 1) / (n + 2)
    edges = [_edges(x[:, i], BINS) if n else np.zeros(0) for i in range(k)]
    coarse = [_edges(x[:, i], PAIR_BINS) if n else np.zeros(0) for i in range(k)]
    model = GamModel(float(np.log(rate / (1 - rate))), edges, coarse, [np.zeros(len(e) + 1) for e in edges])
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[i], x[:, i], side="right") for i in range(k)]
    total = np.full(n, model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(k):
            g, h = gradients()
            size = len(model.tables[i])
            value = RATE * _tree(np.bincount(bins[i], g, size), np.bincount(bins[i], h, size))
            model.tables[i] += value
            total += value[bins[i]]
    low = [np.searchsorted(coarse[i], x[:, i], side="right") for i in range(k)]

    def histograms(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = low[a] * shape[1] + low[b]
        size = shape[0] * shape[1]
        return np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape)

    gains = [(_pair_tree(*histograms(a, b))[1], a, b) for a in range(k) for b in range(a + 1, k)]
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for j, (a, b) in enumerate(model.pairs):
            value = RATE * _pair_tree(*histograms(a, b))[0]
            model.pair_tables[j] += value
            total += value[low[a], low[b]]
    return model


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by 5. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_rows: int = MAX_FIT_ROWS,
) -> GamModel:
    """Model of the labelled documents that are not held out.

    Labels other than 0 and 1, and null ids, are not learnt from. Beyond ``max_rows`` labels
    a hash of the id draws about that many. Only statistics of those texts reach the driver.
    """
    usable = labels.select(F.col("doc_id").alias("_lid"), F.col(label_col).cast("double").alias("_y")).filter(
        "_lid IS NOT NULL AND _y IN (0, 1)"
    ).filter(~held_out("_lid")).distinct()
    count = usable.count()
    if count > max_rows:
        usable = usable.filter(unit(F.xxhash64(F.lit(SEED), "_lid")) < max_rows / count)

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        return pa.array(list(text_features(column)), pa.list_(pa.float64()))

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # about max_rows ids and labels: fixed size
    rows = source.join(F.broadcast(usable), F.col("_id") == F.col("_lid")).select(
        "_id", features("_text").alias("_x"), "_y"
    ).limit(2 * max_rows).toPandas()
    rows = rows.assign(k=[tuple(v) for v in rows["_x"]]).sort_values(["_id", "_y", "k"], kind="stable")
    x = np.array(rows["_x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_gam(x, rows["_y"].to_numpy(dtype=float))


def scorer(model: GamModel, text_col: str) -> Column:
    """Score of a text by a model, between 0 and 1."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(column)), pa.float64())

    return scored(F.col(text_col))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null texts score like empty ones."""
    model = fit_quality(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), scorer(model, text_col).alias("score"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted")
    )


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3
) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    model = fit_quality(docs, labels, id_col, text_col)
    return docs.filter(scorer(model, text_col) >= cut)
