import pytest


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = "\n".join(f"long text line {i} with word{i} and word{i * 7} in it" for i in range(3000))
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near home"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (2, base, "en", "a", 2), (3, base + " today", "en", "b", 3),
        (4, base.upper(), "en", None, 4), (None, base, "en", "b", 5), (None, None, None, None, None),
        (5, None, "en", "a", 6), (6, "", "de", "b", 7), (7, " \t\n ", "de", "b", 8), (8, long, "en", "a", 9),
        (9, long + " tail", "en", "a", 10), (10, "eins zwei drei vier", "de", "b", 11), (11, "42 17 99", None, "c", 12),
        (12, "write to x.y@mail.example.com or +1 (456) 555-2186 now", "en", "c", 13),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashing = ("node", "key", "_id", "_text", "score", "shard", "comp", "_row", "size", "target", "item_id", "quality")
    return df.selectExpr("*", *[f"n_chars AS {c}" for c in clashing])


@pytest.fixture(scope="module")
def no_rows(messy):
    return messy.filter("1 = 0")
