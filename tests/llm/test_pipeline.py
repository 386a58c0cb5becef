from collections import Counter

import pytest

import corpus_pipeline
from berthline.llm import quality_gam
from tests.llm.helpers import SF
from tests.llm.test_decontaminate import brute_force as contaminated
from tests.llm.test_fair_queue import sizes_of
from tests.llm.test_interleave import check_shards
from tests.llm.test_super_minhash import brute_force as grouped


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, written and read again like the driver does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root, tables = tmp_path_factory.mktemp("stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(f"{root}/{name}")
        tables.append(spark.read.parquet(f"{root}/{name}"))
    return tables


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_keep_the_columns(kept):
    assert all(t.columns == kept[0].columns for t in kept[1:-1])
    assert kept[-1].columns == [*kept[0].columns, "shard", "slot"]


def test_quality_drops_what_the_model_rejects(spark, kept):
    scored = quality_gam.score_quality(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept[1]) == ids(scored.filter("predicted = 1"))


def test_one_document_of_each_group_stays(kept):
    want = grouped([(r.doc_id, r.text) for r in kept[1].collect()], 80)
    assert ids(kept[2]) == {i for i, (_, g) in want.items() if g == i}
    assert kept[2].count() == len(ids(kept[2]))


def test_contaminated_documents_go(spark, kept):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {row[0] for row in contaminated([(r.doc_id, r.text) for r in kept[2].collect()], items) if row[-1]}
    assert ids(kept[3]) == ids(kept[2]) - hit


def test_the_mix_fills_its_budget(kept):
    before, after = sizes_of(r.text for r in kept[3].collect()), sizes_of(r.text for r in kept[4].collect())
    assert 1.5 * sum(before) - max(before) <= sum(after) <= 1.5 * sum(before)
    assert max(Counter(r.doc_id for r in kept[4].collect()).values()) <= 2


def test_shards_are_whole_and_match_the_mixture(kept):
    rows = kept[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in kept[4].collect())
    check_shards([(r.shard, r.slot, r.source) for r in rows], 16)


def test_run_gives_the_rows_of_the_stages(spark, kept):
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in kept[5].collect()}
