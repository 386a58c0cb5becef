from berthline.llm import content_sort
from berthline.llm.queries import LLM_ORACLES, LLM_QUERIES
from check_oracle import connect, rows_of
from tests.llm.helpers import SF


def test_query_equals_sql(spark):
    got = LLM_QUERIES["op3_content_sort"](spark, SF)
    want = connect(SF).execute(LLM_ORACLES["op3_content_sort"])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_a_group_that_spans_many_ranges(spark):
    """One text holds most rows, so that splitters cut through its group."""
    rows = [(i, "same text" if i % 4 else f"text {i}") for i in range(4000)] + [(4000, " same  text ")]
    got = content_sort.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    same = [r for r in got if r.doc_id % 4 or r.doc_id == 4000]
    assert {(r.keep_id, r.group_size) for r in same} == {(4000, 3001)}
    assert [r.doc_id for r in same if r.kept] == [4000]
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id % 4 == 0 and r.doc_id < 4000)


def test_texts_with_one_prefix_are_told_apart(spark):
    rows = [(i, "a long common prefix of all texts " + str(i // 2)) for i in range(2000)]
    got = content_sort.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.keep_id == r.doc_id // 2 * 2 and r.group_size == 2 for r in got)


def test_messy_rows(messy):
    got = content_sort.exact_duplicates(messy).collect()
    assert len(got) == messy.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].keep_id == 1 and by_id[1].group_size == 4
    assert by_id[7].keep_id == 7 and by_id[6].keep_id == 7 and by_id[5].keep_id == 7
    assert sum(r.kept for r in got if r.doc_id == 2) == 0


def test_of_repeated_rows_one_is_kept(spark):
    got = content_sort.exact_duplicates(spark.createDataFrame([(1, "x")] * 5, "doc_id bigint, text string")).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {5}


def test_empty_table(no_rows):
    assert content_sort.exact_duplicates(no_rows).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = LLM_QUERIES["op3_content_sort"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
