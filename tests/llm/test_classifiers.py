import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from berthline.llm import byte_cnn, quality_gam
from berthline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_documents_it_has_not_seen(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = LLM_QUERIES["op6_quality_gam"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    seen = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in seen if y == 1], [s for s, y in seen if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_does_not_learn_from_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_gam.held_out("doc_id")
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_gam.fit_quality(docs, labels), quality_gam.fit_quality(docs, flipped)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_gam(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_features_do_not_depend_on_neighbours_or_slices():
    texts = ["", None, "One two, three! Four", "x" * 50, "a\nb\na\n", "ÉÉ éé"]
    whole = quality_gam.text_features(pa.array(texts))
    single = np.concatenate([quality_gam.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single) and not whole[:2].any()


def test_quality_of_messy_rows(spark, messy, no_rows):
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, 1), (None, 1), (3, None), (1, 1), (2, 7)], "doc_id bigint, quality int")
    got = quality_gam.score_quality(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    kept = quality_gam.keep_quality(messy, labels)
    assert kept.columns == messy.columns
    assert quality_gam.score_quality(no_rows, labels).count() == 0
    assert quality_gam.score_quality(messy, labels.filter("1 = 0")).count() == messy.count()


def test_language_on_documents_it_has_not_seen(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = LLM_QUERIES["op7_byte_cnn"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_language_of_messy_rows(messy, no_rows):
    got = byte_cnn.identify(messy).collect()
    assert len(got) == messy.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (5, 6, 7, 11))
    assert {r.lang_pred for r in got} <= {"und", "en", "de"}
    assert byte_cnn.identify(no_rows).count() == 0


def test_windows_cover_whole_texts():
    assert [byte_cnn._cut(np.ones(n, dtype=np.uint8)).sum() for n in (0, 1, 256, 257, 1000)] == [0, 1, 256, 257, 1000]


def test_gradients_train_the_network():
    """Two languages that differ in one letter."""
    rng = np.random.default_rng(1)
    letters = {c: np.array([ord(x) for x in "abe" + c], dtype=np.uint8) for c in "xy"}
    x = np.array([rng.choice(letters[c], 256) for c in "x" * 60 + "y" * 60])
    y = np.array([0] * 60 + [1] * 60)
    model = byte_cnn.fit_byte_cnn(x, y, ["one", "two"])
    assert (model.probabilities(x).argmax(axis=1) == y).mean() > 0.98


def test_texts_with_letters_beyond_ascii():
    assert byte_cnn._has_letter(np.frombuffer("жзи".encode(), dtype=np.uint8))
    assert not byte_cnn._has_letter(np.frombuffer("12 € …".encode(), dtype=np.uint8))
