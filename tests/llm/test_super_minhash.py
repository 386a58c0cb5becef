import re

import numpy as np

from berthline.llm import super_minhash
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF, components, documents, lower_ascii


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def brute_force(rows, least=85):
    """doc_id -> (set size, component id) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    group = components(sets, links)
    return {i: (len(sets[i]), group[i]) for i in sets}


def test_query_equals_brute_force(spark):
    want = brute_force([(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()])
    got = LLM_QUERIES["op8_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 1 << 62, 600, dtype=np.uint64)
    a = np.unique(np.concatenate([shared, rng.integers(1, 1 << 62, 200, dtype=np.uint64)]))
    b = np.unique(np.concatenate([shared, rng.integers(1, 1 << 62, 200, dtype=np.uint64)]))
    same = np.mean(super_minhash.signature(a, 240) == super_minhash.signature(b, 240))
    assert abs(same - 0.6) < 0.1


def test_signature_of_small_sets_fills_all_places():
    one = super_minhash.signature(np.array([5], dtype=np.uint64), 24)
    assert sorted(one >> np.uint64(56)) == list(range(24))


def test_messy_rows(messy):
    got = {(r.doc_id, r.n_shingles): r for r in super_minhash.near_duplicates(messy).collect()}
    assert super_minhash.near_duplicates(messy).count() == messy.count()
    base = 17
    assert got[(2, base)].component_id == 1 and not got[(2, base)].kept
    assert got[(3, base + 1)].component_id == 1
    assert got[(4, base)].component_id == 1
    assert got[(None, base)].component_id == 1 and not got[(None, base)].kept
    assert got[(6, 0)].component_id == 6 and got[(6, 0)].kept
    assert got[(9, got[(8, max(k[1] for k in got if k[0] == 8))].n_shingles + 1)].component_id == 8


def test_one_row_of_a_group_stays(messy):
    kept = super_minhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 5, 6, 7, 8, 10, 11, 12]
    assert sum(none for none, _ in ids) == 1


def test_empty_table(no_rows):
    assert super_minhash.near_duplicates(no_rows).count() == 0
    assert super_minhash.drop_near_duplicates(no_rows).count() == 0
