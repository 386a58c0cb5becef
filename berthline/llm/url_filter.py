"""URL filters: rules first, then naive Bayes over the words that host and path are made of.

Hosts and path tokens run words together. A unigram model of words (counted over all pages)
splits them by Viterbi search. Multinomial naive Bayes, trained on the URLs that the rules
decide and on seed words, then scores the words of every other URL.

Work is done once for each distinct token: its possible words come from a join with the word
counts, its split from one small search, its score from a join with the word scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berthline.operators.skew import salted_join
from berthline.session import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a page must not be about; each counts as this many blocked occurrences.
SEED_WORDS = (
    "adult", "porn", "xxx", "sex", "casino", "poker", "betting", "pills", "viagra", "cheap", "malware", "phishing",
    "warez", "spam",
)
SEED_COUNT = 50


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, under a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: the host follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.

    Both are empty for a null or a text without `://`.
    """
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _pieces(text: Column) -> Column:
    """Stretches of a-z of a text; digits and marks separate."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z]+)"), F.lit(1))


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n): a-z words of all page texts without tags."""
    plain = F.regexp_replace(F.col(html_col), "<[^<>]*+>", " ")
    found = F.regexp_extract_all(F.lower(plain), F.lit(r"\b([a-z]++)\b"), F.lit(1))
    return pages.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _viterbi(piece: str, score: dict[str, float], total: float) -> list[str]:
    """Split with the highest sum of log probabilities; unknown stretches cost more with each letter.

    Known words are tried at their lengths. The best start of an unknown stretch does not depend on
    its end, as every letter costs the same, so it is carried along.
    """
    base, letter = math.log(10.0 / total), math.log(10.0)
    sizes = sorted({len(w) for w in score}, reverse=True)
    best, back = [0.0], [0]
    open_value, open_start = 0.0, 0  # best start of an unknown stretch: its value plus the letters before it
    for end in range(1, len(piece) + 1):
        value, start = open_value + base - end * letter, open_start
        for size in sizes:
            if size <= end and (known := score.get(piece[end - size : end])) is not None and best[end - size] + known > value:
                value, start = best[end - size] + known, end - size
        best.append(value)
        back.append(start)
        if value + end * letter > open_value:
            open_value, open_start = value + end * letter, end
    words, end = [], len(piece)
    while end:
        words.append(piece[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(pieces: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(piece, words) for distinct pieces: their substrings meet the word counts, then one search a piece.

    Only substrings as long as some known word are formed; a piece and a word may have any length.
    """
    lengths = sorted(r.n for r in counts.select(F.length("word").alias("n")).distinct().collect())
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    fitting = F.filter(sizes, lambda n: n <= F.length("piece") - F.col("_start") + 1)
    parts = (
        pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("_start"))
        .select("piece", "_start", F.explode(fitting).alias("_size"))
        .select("piece", F.col("piece").substr(F.col("_start"), F.col("_size")).alias("word")).distinct()
    )
    known = parts.join(counts, "word").groupBy("piece").agg(
        F.collect_list("word").alias("_words"), F.collect_list(F.log(F.col("n") / F.lit(float(max(total, 1))))).alias("_logs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("piece", "_words", "_logs")), strict=True)
            found = [_viterbi(p, dict(zip(w or [], s or [], strict=True)), float(max(total, 1))) for p, w, s in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), pa.array(found, pa.list_(pa.string()))], ["piece", "words"]
            )

    return pieces.join(known, "piece", "left").select("piece", "_words", "_logs").mapInArrow(
        run, "piece string, words array<string>"
    )


def judge_urls(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES,
    seed_words: tuple[str, ...] = SEED_WORDS,
) -> DataFrame:
    """(url, host, path, rule, verdict, log_odds) for each distinct url of ``pages``; null is one of them.

    A rule's verdict stands. Else the url is blocked if its words are likelier in blocked
    urls than in allowed ones; a url without a known word is allowed. ``log_odds`` above 0 means block.
    """
    host, path = split_url(F.col("_url"))
    urls = pages.select(F.col(url_col).alias("_url")).groupBy("_url").agg(F.count(F.lit(1)).alias("_pages"))
    parsed = urls.select("_url", "_pages", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parsed = store(
        parsed.select(
            "*", rule.alias("rule"), verdict.alias("_ruled"), _pieces(F.concat_ws("/", "host", "path")).alias("_pieces")
        ),
        "urls",
    )
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in seed_words], "word string, n bigint")
    counts = store(
        word_counts(pages, html_col).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    uses = parsed.select("_url", "_ruled", "_pages", F.explode("_pieces").alias("piece"))
    by_piece = store(
        uses.groupBy("piece").agg(
            F.sum(F.when(F.col("_ruled") == "block", F.col("_pages")).otherwise(0)).alias("_block"),
            F.sum(F.when(F.col("_ruled") == "allow", F.col("_pages")).otherwise(0)).alias("_allow"),
        ),
        "pieces",
    )
    split = store(segment(by_piece.select("piece"), counts, total), "splits")
    classes = store(
        split.join(by_piece, "piece").select(F.explode("words").alias("word"), "_block", "_allow")
        .groupBy("word").agg(F.sum("_block").alias("_block"), F.sum("_allow").alias("_allow"))
        .join(seeds.select("word", F.col("n").alias("_seed")), "word", "left"),
        "word-classes",
    )
    sums = classes.agg(
        F.sum("_block").alias("b"), F.sum("_allow").alias("a"), F.count(F.lit(1)).alias("v")
    ).first()
    urls_in = parsed.filter("_ruled IS NOT NULL").groupBy("_ruled").agg(F.sum("_pages").alias("n")).collect()
    prior = {r["_ruled"]: r["n"] for r in urls_in}
    start = math.log((prior.get("block", 0) + 1.0) / (prior.get("allow", 0) + 1.0))
    size = float(sums.v or 1)
    # seed words raise their own counts and not the size of the class, which would shift all other words
    in_block = F.col("_block") + F.coalesce("_seed", F.lit(0))
    sizes = math.log(((sums.b or 0) + size) / ((sums.a or 0) + size))
    odds = F.log((in_block + 1.0) / (F.col("_allow") + 1.0)) - F.lit(sizes)
    known = classes.filter(in_block + F.col("_allow") > 0).select("word", odds.alias("_odds"))
    scores = (
        split.select("piece", F.explode("words").alias("word")).join(known, "word")
        .groupBy("piece").agg(F.sum("_odds").alias("_odds"))
    )
    open_uses = uses.filter("_ruled IS NULL").select("_url", "piece")
    judged = salted_join(open_uses, scores, ["piece"], ["_url"]).groupBy("_url").agg(
        F.round(F.sum("_odds") + F.lit(start), 6).alias("log_odds")  # sums in any order agree in six decimals
    )
    return parsed.join(judged.withColumnRenamed("_url", "_jurl"), F.col("_url").eqNullSafe(F.col("_jurl")), "left").select(
        "_url", "host", "path", "rule",
        F.coalesce("_ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds",
    )


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict and log_odds of every row; a null url is allowed."""
    judged = judge_urls(pages, url_col, html_col, rules)
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_page_url"))
    return named.join(judged, F.col("_page_url").eqNullSafe(F.col("_url"))).select(
        "page_id", "host", "path", "rule", "verdict", "log_odds"
    )


def drop_blocked(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Ids of the pages that are not blocked."""
    return filter_urls(pages, id_col, url_col, html_col, rules).filter("verdict = 'allow'").select("page_id")
