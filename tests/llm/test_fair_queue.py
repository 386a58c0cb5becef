import re
from collections import defaultdict

import pytest

from berthline.llm import fair_queue
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF, documents


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows]


def targets(totals, weights=(5, 2, 1), share=1.5, epochs=2):
    """Shares by weight; what is over a limit is shared again until nothing is."""
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in totals else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(totals.values()) - sum(epochs * totals[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        found = {s: epochs * totals[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and found[s] > epochs * totals[s]}
        if not over:
            return found
        full |= over


def check_mix(docs, got):
    """docs: id -> (size, source); got: rows of the operator."""
    totals, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for size, source in docs.values():
        totals[source] += size
        longest[source] = max(longest[source], size)
    want = targets(totals)
    for r in got:
        size, source = docs[r.doc_id]
        assert (r.size, r.source_size) == (size, totals[source])
        assert r.target == pytest.approx(want[source])
        assert r.taken in (0, size, 2 * size)
        taken[source] += r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= 2 * max(longest.values())
    budget = 1.5 * sum(totals.values())
    assert budget - max(longest.values()) <= sum(taken.values()) <= budget


def test_query_meets_its_targets(spark):
    rows = documents(spark).collect()
    sizes = sizes_of(r.text for r in rows)
    docs = {r.doc_id: (n, r.source) for r, n in zip(rows, sizes, strict=True)}
    check_mix(docs, LLM_QUERIES["op10_fair_queue"](spark, SF).collect())


def test_skewed_sources_and_nulls(spark):
    rows = [(i, "w " * (i % 17), "hot" if i % 3 else [None, "a", "é", "zz"][i % 4]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = fair_queue.mix(docs).collect()
    check_mix({i: (i % 17, s) for i, _, s in rows}, got)
    assert {tuple(r) for r in got} == {tuple(r) for r in fair_queue.mix(docs).collect()}


def test_a_source_with_a_small_weight_and_many_words(spark):
    """Finish times of most of its words lie far beyond the budget."""
    rows = [(i, "w " * 5, "c") for i in range(2000)] + [(2000 + i, "w " * 5, s) for i, s in enumerate("ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check_mix({i: (5, s) for i, _, s in rows}, fair_queue.mix(docs).collect())


def test_messy_rows(messy):
    got = fair_queue.mix(messy).collect()
    assert len(got) == messy.count()
    assert all(r.taken <= 2 * r.size for r in got) and {r.size for r in got if r.doc_id in (5, 6, 7)} == {0}


def test_documents_appear_as_often_as_they_are_taken(messy, no_rows):
    mixed = fair_queue.mix_documents(messy)
    assert mixed.columns == messy.columns
    taken = sum(r.taken for r in fair_queue.mix(messy).collect())
    served = sum(sizes_of(r.text for r in mixed.collect()))
    assert abs(taken - served) <= 2 * max(sizes_of(r.text for r in messy.collect()))
    assert {r.doc_id for r in mixed.collect()} >= {5, 6, 7}
    assert fair_queue.mix_documents(no_rows).count() == 0 and fair_queue.mix(no_rows).count() == 0


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.taken) for r in fair_queue.mix(docs).collect()] == [(0, 0.0, 0)] * 2
