"""Personal data by patterns, and by bootstrapped contexts.

Strict patterns find e-mail addresses, IP addresses, card and phone numbers. These seeds
have contexts, the words around them. Identifiers of a looser form that stand in the same
contexts form a graph with them: a context is trusted as far as the identifiers in it are,
an identifier as far as its contexts are. Rounds of scoring over that graph, until the scores
settle, find the contexts that announce a kind of data, and those add the looser identifiers they hold.
What they add counts as seeds from then on and brings its own contexts, until nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthline.operators.skew import salted_join
from berthline.session import store

KINDS = ("email", "ip", "card", "phone")
#: Scoring ends when no pattern's confidence moves by more than this.
SETTLED = 0.01
#: Longest word of a context; a longer one is no word that announces anything, and ends the search for one.
LONGEST_WORD = 256
#: A context adds identifiers from this confidence on, and with this many different seeds.
CONFIDENCE, SEEDS = 0.8, 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# Repeats that cannot give back what they took: from any place inside a run of digits a
# match fails just as from its start, so these find what plain repeats do, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_LOOSE_EMAIL = re.compile(r"(?<![^\s<>(),;:\"'\[\]])[^\s@<>(),;:\"'\[\]]++@[^\s@<>(),;:\"'\[\]]++")
_LOOSE_NUMBER = re.compile(r"(?<![\w+])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+(?!\w)")
_TRIM = re.compile(r"^[^\w]+|[^\w]+$")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, from the @ outwards.

    The leftmost match for an @ starts with the run of local characters before it, or
    behind the match before; no other start in that run ends differently.
    """
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all strict matches, by kind and start, in code points."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def _loose(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, kinds it could be as bits) of looser identifiers that touch no strict match."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), 1) for m in _LOOSE_EMAIL.finditer(text)]
    for m in _LOOSE_NUMBER.finditer(text):
        digits = len(_DIGITS.sub("", m[0]))
        groups = len(re.findall(r"[0-9]+", m[0]))
        kinds = (2 if groups == 4 and digits <= 12 else 0) | (4 if 13 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)
        if kinds:
            found.append((m.start(), m.end(), kinds))
    strict: list[list[int]] = []  # disjoint, by start
    for s, e in sorted(taken):
        if strict and s < strict[-1][1]:
            strict[-1][1] = max(strict[-1][1], e)
        else:
            strict.append([s, e])
    at, free = 0, 0
    for a, b, kinds in sorted(found):
        while at < len(strict) and strict[at][1] <= a:
            at += 1
        if a >= free and (at == len(strict) or strict[at][0] >= b):
            free = b
            yield a, b, kinds


def _words_before(text: str, line: int, a: int) -> list[str]:
    """The two words that end before ``a`` on the line that starts at ``line``; <s> is the start of the line."""
    words: list[str] = []
    while len(words) < 2:
        while a > line and text[a - 1].isspace():
            a -= 1
        if a == line:
            return ["<s>", *words]
        end = a
        while a > line and not text[a - 1].isspace():
            a -= 1
            if end - a > LONGEST_WORD:
                return words
        if (word := _TRIM.sub("", text[a:end]).lower()):
            words.insert(0, word)
    return words


def _word_behind(text: str, b: int) -> list[str]:
    """The word that starts at or after ``b`` on its line; </s> is the end of the line."""
    while True:
        while b < len(text) and text[b] != "\n" and text[b].isspace():
            b += 1
        if b == len(text) or text[b] == "\n":
            return ["</s>"]
        start = b
        while b < len(text) and not text[b].isspace():
            b += 1
            if b - start > LONGEST_WORD:
                return []
        if (word := _TRIM.sub("", text[start:b]).lower()):
            return [word]


def _contexts(text: str, a: int, b: int) -> list[str]:
    """Lexical patterns of a span on its line: the two words before it, the words on either side, and the word before alone.

    <s> and </s> stand for the start and the end of the line; punctuation is no word.
    """
    before, behind = _words_before(text, text.rfind("\n", 0, a) + 1, a), _word_behind(text, b)
    found = []
    if len(before) == 2:
        found.append("2 " + " ".join(before))
    if before and behind:
        found.append(f"1 {before[-1]} _ {behind[0]}")
    if before and before[-1] != "<s>":
        found.append(f"b {before[-1]}")
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, slots = [], []
        for text in batch.column("_text").to_pylist():
            if not text or not _ANY.search(text):
                base.append([])
                slots.append([])
                continue
            strict = base_spans(text)
            base.append([{"k": k, "s": s, "e": e} for k, s, e in strict])
            own = []
            for k, s, e in strict:
                own.append({"k": k, "f": 1 << k, "s": s, "e": e, "i": text[s:e].lower(), "c": _contexts(text, s, e)})
            for s, e, kinds in _loose(text, [(s, e) for _, s, e in strict]):
                own.append({"k": None, "f": kinds, "s": s, "e": e, "i": text[s:e].lower(), "c": _contexts(text, s, e)})
            slots.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_hash"), pa.array(base, _BASE), pa.array(slots, _SLOTS)],
            ["_id", "_hash", "_base", "_slots"],
        )


_BASE = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
_SLOTS = pa.list_(pa.struct([
    ("k", pa.int32()), ("f", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("i", pa.string()),
    ("c", pa.list_(pa.string())),
]))
_SPAN_TYPE = "array<struct<k:int,s:bigint,e:bigint>>"


def _scored(pairs: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (context, kind, instance, seed, open), and patterns (context, kind, p and n, its seeds)."""
    known = pairs.join(seeds, "instance").select("context", "kind").distinct()
    marked = seeds.select("instance", "kind", F.lit(True).alias("_seed"))
    # instances of every context that has a seed of a kind; a loose instance counts for that kind if its form fits
    edges = store(
        salted_join(pairs, known, ["context"], ["instance"]).join(marked, ["instance", "kind"], "left").select(
            "context", "kind", "instance", F.coalesce("_seed", F.lit(False)).alias("seed"),
            (F.col("own").isNull() & (F.col("fits").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0)).alias("open"),
        ),
        "edges",
    )
    trust, patterns = None, None
    while True:
        if trust is None:
            weighed = edges.withColumn("w", F.col("seed").cast("double"))
        else:
            weighed = edges.join(trust, ["instance", "kind"], "left").withColumn(
                "w", F.when(F.col("seed"), 1.0).when(F.col("open"), F.coalesce("t", F.lit(0.0))).otherwise(0.0)
            )
        before = patterns
        patterns = store(
            weighed.groupBy("context", "kind").agg(
                (F.sum("w") / (F.count(F.lit(1)) + 0.5)).alias("p"), F.sum(F.col("seed").cast("int")).alias("n")
            ),
            "patterns",
        )
        if before is not None:  # weights only rise, so the scores settle
            moved = patterns.join(before.withColumnRenamed("p", "_p").drop("n"), ["context", "kind"])
            if moved.filter(F.abs(F.col("p") - F.col("_p")) > SETTLED).isEmpty():
                return edges, patterns
        doubt = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("p"), F.lit(1e-6))))
        trust = (
            edges.filter("open").join(patterns.filter(F.col("n") >= 2), ["context", "kind"])
            .groupBy("instance", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("t"))
        )


def trusted_contexts(slots: DataFrame, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(context, kind) pairs that announce a kind of data.

    ``slots`` has one row per identifier occurrence and context: context, instance, kind
    (null if no strict pattern matched) and fits (kinds its form allows, as bits). The loose
    instances of trusted contexts are seeds of the next hop; the last one adds none.
    """
    pairs = store(
        slots.groupBy("context", "instance").agg(F.max("kind").alias("own"), F.bit_or("fits").alias("fits")), "slots"
    )
    sure = store(pairs.filter("own IS NOT NULL").select("instance", F.col("own").alias("kind")).distinct(), "seeds")
    while True:
        edges, patterns = _scored(pairs, sure)
        trusted = patterns.filter((F.col("p") >= confidence) & (F.col("n") >= seeds)).select("context", "kind")
        found = store(
            edges.filter("open AND NOT seed").join(trusted, ["context", "kind"]).select("instance", "kind").distinct(),
            "found",
        )
        if found.isEmpty():
            return trusted
        sure = store(sure.unionByName(found), "seeds")


def _format(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _base and _spans of every row: strict spans, and all spans, as arrays of (k, s, e).

    k is a kind's place in KINDS, s and e are code points, the end exclusive. Null texts
    have no spans. Rows that repeat an id and a text share their result.
    """
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_hash", T.LongType()),
        T.StructField("_base", T.ArrayType(T.StructType([
            T.StructField("k", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())
        ]))),
        T.StructField("_slots", T.ArrayType(T.StructType([
            T.StructField("k", T.IntegerType()), T.StructField("f", T.IntegerType()), T.StructField("s", T.LongType()),
            T.StructField("e", T.LongType()), T.StructField("i", T.StringType()),
            T.StructField("c", T.ArrayType(T.StringType())),
        ]))),
    ])
    rows = store(
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
        .mapInArrow(_scan, schema),
        "spans",
    )
    slots = rows.select("_id", "_hash", F.explode("_slots").alias("x")).select(
        "_id", "_hash", F.col("x.k").alias("kind"), F.col("x.f").alias("fits"), F.col("x.s").alias("s"),
        F.col("x.e").alias("e"), F.col("x.i").alias("instance"), F.explode("x.c").alias("context"),
    )
    contexts = trusted_contexts(slots.select("context", "instance", "kind", "fits"))
    added = (
        salted_join(slots.filter("kind IS NULL").drop("kind"), contexts, ["context"], ["instance", "_hash"])
        .filter(F.col("fits").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0)
        .groupBy("_id", "_hash", "s", "e").agg(F.min("kind").alias("k"))
        .groupBy("_id", "_hash").agg(F.collect_list(F.struct("k", "s", "e")).alias("_added"))
        .select(F.col("_id").alias("_aid"), F.col("_hash").alias("_ahash"), "_added")
    )
    empty = F.array().cast(_SPAN_TYPE)
    return rows.join(
        added, F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_hash") == F.col("_ahash")), "left"
    ).select("_id", "_base", F.concat("_base", F.coalesce("_added", empty)).alias("_spans"))


def _of_kind(k: int):
    return lambda x: x["k"] == k


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the strict matches of each kind, their digest, and all spans of every row."""
    found = find_personal_data(docs, id_col, text_col)
    counts = [
        F.size(F.filter("_base", _of_kind(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return found.select(
        F.col("_id").alias("doc_id"), *counts, F.sha2(_format(F.col("_base")), 256).alias("base_sha256"),
        _format(F.col("_spans")).alias("spans"),
    )


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, one row each: kind, start and end, for masking or review."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return find_personal_data(docs, id_col, text_col).select(F.col("_id").alias("doc_id"), F.explode("_spans").alias("x")).select(
        "doc_id", F.get(kinds, F.col("x.k")).alias("kind"), F.col("x.s").alias("start"), F.col("x.e").alias("end")
    )
