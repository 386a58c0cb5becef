import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from berthline.llm import pii_bootstrap
from berthline.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF, documents

KINDS = ("email", "ip", "card", "phone")


def plain_base(text):
    """The contract's patterns as they stand."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii_bootstrap.luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aé@.+- ()0123459\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii_bootstrap.base_spans(text) == plain_base(text)


def test_luhn():
    assert pii_bootstrap.luhn("4111111111111111") and not pii_bootstrap.luhn("4111111111111112")


def as_text(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def test_query_equals_the_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    got = LLM_QUERIES["op9_personal_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert {x for x in as_text(base).split(",") if x} <= {x for x in r.spans.split(",") if x}


def test_contexts_of_seeds_find_looser_identifiers(spark):
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice(("oak", "lake", "stone", "river", "cloud")) for _ in range(6))
    rows = [(i, f"{filler()} please mail user{i}@mail{i}.example.com {filler()}") for i in range(30)]
    rows += [(100, f"{filler()} please mail root@localhost thanks"), (101, f"{filler()} the score root@localhost thanks")]
    rows += [(200 + i, f"{filler()} version number {i}.{i} {filler()}") for i in range(20)]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    text = dict(rows)[100]
    at = text.index("root@")
    assert got[100].spans == f"email:{at}:{at + len('root@localhost')}" and got[100].n_email == 0
    assert got[101].spans == ""
    assert all(got[i].spans == "" for i in range(200, 220))


def test_messy_rows(messy, no_rows):
    got = pii_bootstrap.personal_data(messy).collect()
    assert len(got) == messy.count()
    row = next(r for r in got if r.doc_id == 12)
    assert (row.n_email, row.n_phone, row.n_ip, row.n_card) == (1, 1, 0, 0)
    assert all(r.spans == "" for r in got if r.doc_id in (1, 5, 6, 7, None))
    assert pii_bootstrap.personal_data(no_rows).count() == 0


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + " (" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii_bootstrap.base_spans(text)
        list(pii_bootstrap._loose(text, []))


def test_many_loose_numbers_take_linear_time():
    text = " ".join(f"555 {i % 900 + 100} {i % 9000 + 1000}" + (" +1 555 123 4567," if i % 3 == 0 else ";") for i in range(60_000))
    began = time.perf_counter()
    strict = [(s, e) for _, s, e in pii_bootstrap.base_spans(text)]
    loose = list(pii_bootstrap._loose(text, strict))
    assert time.perf_counter() - began < 20
    own = {(a, b) for a, b, _ in loose}
    ends = sorted([*strict, *own])
    assert len(own) > 10_000 and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]) if x in own or y in own)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.+ ()0159,-", max_size=40))
def test_loose_spans_are_the_first_that_touch_nothing(text):
    taken = [(s, e) for _, s, e in pii_bootstrap.base_spans(text)]
    busy, want = list(taken), []
    for a, b, kinds in sorted(candidates(text)):
        if not any(s < b and a < e for s, e in busy):
            busy.append((a, b))
            want.append((a, b, kinds))
    assert list(pii_bootstrap._loose(text, taken)) == want


def candidates(text):
    """All looser identifiers of a text, also overlapping ones."""
    found = [(m.start(), m.end(), 1) for m in pii_bootstrap._LOOSE_EMAIL.finditer(text)]
    for m in pii_bootstrap._LOOSE_NUMBER.finditer(text):
        digits, groups = sum(c.isdigit() for c in m[0]), len(re.findall(r"[0-9]+", m[0]))
        kinds = (2 if groups == 4 and digits <= 12 else 0) | (4 if 13 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)
        if kinds:
            found.append((m.start(), m.end(), kinds))
    return found


def test_contexts_see_whole_words_at_any_distance():
    long = "z" * 60
    text = f"call {long}   \t{' ' * 90}555-1234 {' ' * 70} {long} x"
    a = text.index("555")
    assert pii_bootstrap._contexts(text, a, a + 8) == [f"2 call {long}", f"1 {long} _ {long}", f"b {long}"]
    huge = "z" * 500
    text = f"call {huge} 555-1234 {huge}"
    a = text.index("555")
    assert pii_bootstrap._contexts(text, a, a + 8) == []


def test_contexts_at_the_ends_of_lines():
    def at(text, span):
        return pii_bootstrap._contexts(text, text.index(span), text.index(span) + len(span))

    assert at("x\nPhone: 555-1234\ny", "555-1234") == ["2 <s> phone", "1 phone _ </s>", "b phone"]
    assert at("555-1234 is mine", "555-1234") == ["1 <s> _ is"]
    assert at("x\n555-1234", "555-1234") == ["1 <s> _ </s>"]


def test_labels_find_looser_identifiers(spark):
    rows = [(i, f"oak lake\nPhone: +1 555 123 {1000 + i}\nriver stone") for i in range(30)]
    rows += [(100, "contact\nPhone: 555 123 9999"), (101, "weights\nTotal: 555 123 9999")]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].spans == "phone:15:27" and got[100].n_phone == 0
    assert got[101].spans == ""


def test_found_identifiers_find_further_ones(spark):
    rng = random.Random(7)
    filler = lambda: " ".join(rng.choice(("oak", "lake", "stone", "river", "cloud")) for _ in range(6))
    # strict seeds vouch for "please mail", what that finds for "kindly ask", which has no strict seed
    rows = [(i, f"{filler()} please mail user{i}@mail{i}.example.com {filler()}") for i in range(60)]
    rows += [(100 + i, f"{filler()} please mail root{i}@localhost {filler()}") for i in range(8)]
    rows += [(200 + i, f"{filler()} kindly ask root{i}@localhost {filler()}") for i in range(8)]
    rows += [(300, f"{filler()} kindly ask admin@intranet {filler()}"), (301, f"{filler()} never mind admin@elsewhere {filler()}")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = dict(rows)[300].index("admin@")
    assert got[300] == f"email:{at}:{at + len('admin@intranet')}"
    assert got[301] == ""
