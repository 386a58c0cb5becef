"""Language identification by a convolutional network over bytes.

A window of bytes is embedded, filters of several widths slide over it, the strongest
response of each filter is kept, and a softmax over those gives the languages. A text is
cut into windows of a fixed length, all of which are scored; its probabilities are the
means over its windows, weighted by the bytes in them. Everything is trained here, in numpy, on labelled text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthline.llm.quality_gam import held_out
from berthline.llm.rows import unit
from berthline.llm.text import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 6
#: Most labelled documents of a language that a fit uses, drawn by a hash of the id, and windows of each.
MAX_FIT_ROWS, FIT_WINDOWS = 500, 4
STEPS, BATCH, RATE = 500, 64, 0.01
#: Windows that are scored at once.
BLOCK = 256
SEED = 3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class ByteCnn:
    """Languages, byte embedding, filters as (width * embedding, filters) side by side, biases, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input patches, strongest response of each filter in each window, and where it is."""
        n, widest = len(windows), max(WIDTHS)
        padded = np.zeros((n, WINDOW + widest - 1), dtype=np.uint8)
        padded[:, :WINDOW] = windows
        cells = self.embedding[padded]
        span = EMBEDDING * widest
        steps = cells.strides
        view = np.lib.stride_tricks.as_strided(
            cells, (n, WINDOW, span), (steps[0], steps[1], steps[2]), writeable=False
        )
        patches = view.reshape(n * WINDOW, span)
        out = (patches @ self.filters).reshape(n, WINDOW, -1)
        return patches, out.max(axis=1), out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        if not len(windows):
            return np.zeros((0, len(self.languages)))
        parts = []
        for i in range(0, len(windows), BLOCK):
            top = self.responses(windows[i : i + BLOCK])[1] + self.bias
            parts.append(_softmax(np.maximum(top, 0) @ self.dense + self.dense_bias))
        return np.concatenate(parts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    """Which weights a filter has: one of width w sees only the first w bytes of a patch."""
    widest = max(WIDTHS)
    mask = np.zeros((EMBEDDING * widest, FILTERS * len(WIDTHS)), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: EMBEDDING * w, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def fit_byte_cnn(windows: np.ndarray, target: np.ndarray, languages: list[str]) -> ByteCnn:
    """Adam on the cross entropy, over batches in a seeded order."""
    rng = np.random.default_rng(SEED)
    mask = _mask()
    n_filters = mask.shape[1]
    model = ByteCnn(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(n_filters, dtype=np.float32),
        rng.normal(0, 0.3, (n_filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    model.embedding[0] = 0
    names = ("embedding", "filters", "bias", "dense", "dense_bias")
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    if len(languages) < 2:
        return model
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick], target[pick]
        patches, top, out = model.responses(x)
        where = out.argmax(axis=1)
        top = top + model.bias
        hidden = np.maximum(top, 0)
        d = _softmax(hidden @ model.dense + model.dense_bias)
        d[np.arange(BATCH), y] -= 1
        d /= BATCH
        grad = {"dense": hidden.T @ d, "dense_bias": d.sum(axis=0)}
        back = (d @ model.dense.T) * (top > 0)
        grad["bias"] = back.sum(axis=0)
        at = where + np.arange(BATCH)[:, None] * WINDOW
        used = patches[at]
        grad["filters"] = np.einsum("bfs,bf->sf", used, back) * mask
        to_cells = back[:, :, None] * model.filters.T[None]
        padded = np.zeros((BATCH, WINDOW + max(WIDTHS) - 1), dtype=np.uint8)
        padded[:, :WINDOW] = x
        grad["embedding"] = np.zeros_like(model.embedding)
        for o in range(max(WIDTHS)):
            byte = padded[np.arange(BATCH)[:, None], where + o]
            np.add.at(grad["embedding"], byte, to_cells[:, :, o * EMBEDDING : (o + 1) * EMBEDDING])
        grad["embedding"][0] = 0
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, (getattr(model, k) - move).astype(np.float32))
    return model


def _cut(data: np.ndarray) -> np.ndarray:
    """Windows of one text; the last is filled up with zeros."""
    n = -(-len(data) // WINDOW)
    result = np.zeros((n, WINDOW), dtype=np.uint8)
    result.reshape(-1)[: len(data)] = data
    return result


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_rows: int = MAX_FIT_ROWS,
) -> ByteCnn:
    """Model of the documents with a language and an id that are not held out, about ``max_rows`` of each language."""
    known = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")
    ).filter("_lang IS NOT NULL AND _id IS NOT NULL AND _text IS NOT NULL").filter(~held_out("_id"))
    # one row per language, as many as the network has outputs
    counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit_byte_cnn(np.zeros((0, WINDOW), dtype=np.uint8), np.zeros(0, dtype=int), [])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, max_rows / n)])
    drawn = (
        known.withColumn("_u", unit(F.xxhash64(F.lit(SEED), "_id")))
        .filter(F.col("_u") < F.element_at(share, F.col("_lang"))).limit(2 * max_rows * len(counts))
    )
    # evenly spaced windows of each drawn text, cut before they leave the executors
    at = F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1))
    span = F.greatest(F.length("_text") - WINDOW, F.lit(0))
    pieces = F.transform(at, lambda i: F.substring(F.col("_text"), (span * i / (FIT_WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW)))
    rows = sorted(tuple(r) for r in drawn.select("_lang", "_u", pieces.alias("_p")).collect())
    languages = sorted({r[0] for r in rows})
    windows, target = [], []
    for lang, _, texts in rows:
        for piece in dict.fromkeys(texts):
            data = np.frombuffer(piece.encode()[:WINDOW], dtype=np.uint8)
            if len(data):
                windows.append(_cut(data)[0])
                target.append(languages.index(lang))
    if not windows:
        return fit_byte_cnn(np.zeros((0, WINDOW), dtype=np.uint8), np.zeros(0, dtype=int), [])
    return fit_byte_cnn(np.array(windows), np.array(target), languages)


def _has_letter(data: np.ndarray) -> bool:
    if _LETTER[data].any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def _predict(model: ByteCnn, column: pa.Array) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(column), np.zeros(len(column))
    if not model.languages:
        return names, scores
    for part in slices(column):
        cuts = [_cut(part.data[a:b]) for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True)]
        p = model.probabilities(np.concatenate(cuts))
        at = 0
        for i, own in enumerate(cuts):
            a, b = part.bounds[i], part.bounds[i + 1]
            if len(own) and _has_letter(part.data[a:b]):
                weight = np.full(len(own), WINDOW, dtype=float)
                weight[-1] = (b - a) - WINDOW * (len(own) - 1)
                mean = weight @ p[at : at + len(own)] / weight.sum()
                best = int(mean.argmax())
                names[part.first_row + i], scores[part.first_row + i] = model.languages[best], mean[best]
            at += len(own)
    return names, np.clip(scores, 0, 1)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A null text, or one without a letter, is `und` with score 0, and so is every text if
    no language could be learnt. Repeated rows get the same prediction.
    """
    model = fit_languages(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(model, batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ])
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
