import zlib
from collections import Counter

from berthline.llm import interleave
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF, documents


def test_query_matches_the_mixture(spark):
    docs = {r.doc_id: r for r in documents(spark).collect()}
    got = LLM_QUERIES["op4_interleave"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        data = (docs[r.doc_id].text or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        assert r.law == "rows" and r.grown_shard is None
    check_shards([(r.shard, r.slot, docs[r.doc_id].source) for r in got], 16)


def check_shards(rows, shards, apart=2):
    slots = {}
    for shard, slot, _ in rows:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1
    by_source = Counter((source, shard) for shard, _, source in rows)
    for source in {s for _, _, s in rows}:
        own = [by_source[(source, i)] for i in range(shards)]
        assert max(own) - min(own) <= apart


def test_reruns_agree(spark):
    first = {tuple(r) for r in LLM_QUERIES["op4_interleave"](spark, SF).collect()}
    assert first == {tuple(r) for r in LLM_QUERIES["op4_interleave"](spark, SF).collect()}


def test_a_hot_source_and_many_single_ones(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = interleave.shard_slots(docs, shards=7).collect()
    source = {i: s for i, _, s in rows}
    check_shards([(r.shard, r.slot, source[r.doc_id]) for r in got], 7, apart=8)


def test_messy_rows_all_get_a_slot(messy):
    got = interleave.shard_slots(messy).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(i, 0) for i in range(len(got))]
    rows = interleave.shard_documents(messy, shards=4)
    assert [c for c in rows.columns if c != "slot"] == [c for c in messy.columns if c != "shard"] + ["shard"]
    found = rows.collect()
    check_shards([(r.shard, r.slot, None) for r in found], 4)
    key = lambda r: repr((r.doc_id, r.text))
    assert sorted(map(key, found)) == sorted(map(key, messy.collect()))


def test_empty_table(no_rows):
    assert interleave.shard_slots(no_rows).count() == 0
    assert interleave.shard_documents(no_rows).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = LLM_QUERIES["op4_interleave"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
