import hashlib
import re

import numpy as np
import pyarrow as pa

from berthline.llm import decontaminate
from berthline.llm.queries import LLM_QUERIES
from berthline.llm.text import slices
from tests.llm.helpers import SF, documents, lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower_ascii(text or ""))


def brute_force(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if w and len(w) < 10:
            windows.setdefault(tuple(w), set()).add(i)
        for j in range(len(w) - 9):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    sizes = {len(k) for k in windows}
    result = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[j : j + size]))) is not None:
                    hit.update(range(j, j + size))
                    found |= own
        found.discard("None")
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        result.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(result, key=repr)


def rows_of(df):
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr
    )


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(LLM_QUERIES["op2_decontaminate"](spark, SF)) == brute_force(docs, items)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, ""), (4, None),
    (5, "two three four five six seven eight nine ten eleven"), (6, "alpha beta beta alpha beta"), (6, "short   ITEM"),
]
DOCS = [
    (1, "x One, two three four five six seven eight nine ten! eleven twelve y"), (2, "a short item, a short item"),
    (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "alpha beta beta alpha beta beta"),
    (7, "short"), (8, "item short item short"), (8, "item short item short"),
]


def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_short_items_overlaps_and_nulls(spark):
    docs, items = tables(spark)
    want = brute_force(DOCS, [(str(i), t) for i, t in ITEMS])
    assert rows_of(decontaminate.contamination(docs, items)) == want


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    docs, items = tables(spark)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert rows_of(decontaminate.contamination(docs, items)) == brute_force(DOCS, [(str(i), t) for i, t in ITEMS])


def test_items_without_an_id_and_items_of_equal_words(spark):
    items = [(None, "short item"), (1, "Plain words, here"), (2, "plain  words here"), (None, "plain words here")]
    docs = [(1, "a short item here"), (2, "some plain words here"), (3, "nothing")]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert rows_of(got) == brute_force(docs, [(str(i), t) for i, t in items])
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r.longest_item) for r in got.collect()} == {
        1: (2, 0, True, None), 2: (3, 2, True, "1"), 3: (0, 0, False, None)}


def test_many_items_of_one_text_cost_as_much_as_one():
    text = "one passage of twelve words that many items of a benchmark share today"
    block = decontaminate.benchmark_block([str(i) for i in range(1000)], [text] * 1000)
    part = next(slices(pa.array([" ".join([text, "x"] * 4000)])))
    assert len(decontaminate.find_matches(block, part)[0].row) == 4000 * 4 and len(block.ids[0]) == 1000


def test_longest_match_and_its_place(spark):
    docs, items = tables(spark)
    row = decontaminate.contamination(docs, items).filter("doc_id = 1").first()
    assert (row.longest, row.longest_at, row.longest_item) == (12, 1, "1")


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 4, 500).astype(np.int32)
    order = decontaminate.suffix_array(tokens, 10)
    cut = lambda p: [int(x) for x in tokens[p : p + 10]]
    heads = [cut(p)[: (cut(p) + [0]).index(0)] for p in order]
    assert heads == sorted(heads) and len(order) == np.count_nonzero(tokens)


def test_matches_across_slices_of_any_size():
    texts = [t for _, t in DOCS]
    block = decontaminate.benchmark_block([str(i) for i, t in ITEMS if t], [t for _, t in ITEMS if t])
    whole = [decontaminate.find_matches(block, p)[0].row.size for p in slices(pa.array(texts))]
    single = [decontaminate.find_matches(block, p)[0].row.size for p in slices(pa.array(texts), 1)]
    assert sum(whole) == sum(single) > 0


def test_clean_documents_stay(spark, messy, no_rows):
    _, items = tables(spark)
    kept = decontaminate.drop_contaminated(messy, items)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert decontaminate.drop_contaminated(no_rows, items).count() == 0
    assert decontaminate.drop_contaminated(messy, items.filter("1 = 0")).count() == messy.count()
