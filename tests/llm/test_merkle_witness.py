import hashlib
import zlib
from collections import defaultdict

import pytest

from berthline.llm import merkle_witness
from berthline.llm.merkle_witness import WitnessTree
from tests.llm.helpers import SF, documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, more=0):
    chars = None if doc["n_chars"] is None else doc["n_chars"] + more
    values = (doc["doc_id"], doc["source"], doc["lang"], chars, doc["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def beside(tree, at):
    """(side, digest) from a leaf up; no digest where a node is alone."""
    for level in tree[:-1]:
        other = at ^ 1
        yield other < at, level[other] if other < len(level) else ""
        at //= 2


def brute_force(docs):
    by_lang = defaultdict(list)
    for d in docs:
        by_lang[d["lang"]].append(d)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by_lang[x].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
    trees = {x: levels([leaf(d) for d in by_lang[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    rows = []
    for i, x in enumerate(langs):
        for at, d in enumerate(by_lang[x]):
            path = [*beside(trees[x], at), *beside(top, i)]
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            node = leaf(d, 1 if hit else 0)
            for left, other in path:
                node = sha(other + node if left else node + other)
            proof = sha("".join(other for _, other in path))
            rows.append((d["doc_id"], leaf(d), trees[x][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(rows, key=repr)


def check(df, **options):
    got = sorted((tuple(r) for r in merkle_witness.audit(df, **options).collect()), key=repr)
    assert got == brute_force([r.asDict() for r in df.select(*merkle_witness.FIELDS).collect()])
    return got


@pytest.mark.parametrize("bits", [1, 3, merkle_witness.BLOCK_BITS])
def test_equals_brute_force_with_blocks_of_any_size(spark, bits):
    got = check(documents(spark), block_bits=bits)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_messy_rows(spark, messy, no_rows):
    check(messy, block_bits=2)
    assert merkle_witness.audit(no_rows).count() == 0


def test_null_fields_differ_from_empty_ones(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "", 0, ""), (7, "a", "é", 3, "x")], schema)
    got = check(df)
    assert len({r[1] for r in got}) == 3
    alone = check(df.filter("doc_id = 7"))
    assert alone[0][1] == alone[0][2] == alone[0][3]


def test_untouched_copies_of_one_row_and_a_language_per_document(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    same = [(5, "s", "en", 2, "ab")] * 300
    own = [(i, "s", f"l{i:03d}", 2, "ab") for i in range(300)]
    check(spark.createDataFrame(same + own, schema).repartition(5), block_bits=4)


def test_proofs_fold_to_the_root(spark):
    rows = merkle_witness.manifest(documents(spark), block_bits=4)
    assert rows.filter(merkle_witness.fold(rows.leaf, rows.proof) != rows.root).count() == 0


def test_witnesses_grow_as_siblings_complete():
    tree = WitnessTree(5, 3)
    nodes = [sha(str(i)).encode() for i in range(5)]
    tree.append(nodes[0])
    assert tree.siblings[0, 0] == b""
    tree.append(nodes[1])
    assert tree.siblings[0, 0] == nodes[1] and tree.siblings[1, 0] == nodes[0] and tree.siblings[0, 1] == b""
    for node in nodes[2:]:
        tree.append(node)
    assert [h for h, _, _ in tree.open] == [2, 0]
    want = levels([n.decode() for n in nodes])
    assert tree.siblings[0, 1].decode() == want[1][1] and tree.siblings[3, 1].decode() == want[1][0]
    assert tree.close(3).decode() == want[-1][0]
    assert tree.siblings[4].tolist()[:2] == [b"", b""] and tree.siblings[4, 2].decode() == want[2][0]


def test_reads_the_given_table(spark):
    from berthline.llm.queries import LLM_QUERIES

    assert LLM_QUERIES["op12_merkle_witness"](spark, SF).count() == documents(spark).count()
