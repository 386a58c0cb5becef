"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clip used around the logit, and Lehmer generator constants.
PROBABILITY_CLIP = 1e-6
LEHMER_MODULUS = 2147483647
LEHMER_FACTORS = (48271, 69621, 16807)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(name: str) -> Column:
    """Text or number to a non-negative double; anything unreadable, NaN or null is 0."""
    parsed = F.col(name).try_cast("double")
    return F.abs(F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0)))


def numeric_or_null(name: str) -> Column:
    """Text to double, with unreadable and NaN values as null."""
    parsed = F.col(name).try_cast("double")
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def coalesce_zero(c: Column | str) -> Column:
    if isinstance(c, str):
        return F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), 0.0D)")
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def rounded(c: Column | str, decimals: int = 6) -> Column:
    """Half-up rounding by plain arithmetic; ``round`` on doubles goes through decimals row by row."""
    scale = F.lit(float(10**decimals))
    return F.floor(col(c) * scale + F.lit(0.5)) / scale


def epoch_ms(name: str) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session time zone."""
    gap = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(
        f"extract(DAY FROM {gap}) * 86400000L + extract(HOUR FROM {gap}) * 3600000L"
        f" + extract(MINUTE FROM {gap}) * 60000L + CAST(extract(SECOND FROM {gap}) * 1000 AS BIGINT)"
    )


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clip_probability(p: Column, eps: float = PROBABILITY_CLIP) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p)))


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.log(q / (F.lit(1.0) - q))


def apply_temperature(p: Column | str, temperature: Column | float) -> Column:
    """Soften (T > 1) or sharpen (T < 1) a probability on the logit scale."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return sigmoid(logit(col(p)) / t)


def binarize(p: Column | str, threshold: float = 0.5, strict: bool = False) -> Column:
    """1 from the threshold on (``strict``: above it), else 0; null stays null."""
    value = col(p)
    hit = value > F.lit(threshold) if strict else value >= F.lit(threshold)
    return F.when(value.isNotNull(), hit.cast("int"))


def lehmer(key: Column, stream: int = 0) -> Column:
    """Seedable pseudo-random integer in [0, 2^31 - 1) from an integer key.

    Plain integer arithmetic: independent of partitioning and the same in any SQL engine.
    """
    value = F.pmod(key.cast("bigint") + F.lit(7919 * (stream + 1)).cast("bigint"), F.lit(LEHMER_MODULUS).cast("bigint"))
    for factor in LEHMER_FACTORS:
        value = F.pmod(value * F.lit(factor).cast("bigint") + F.lit(104729).cast("bigint"),
                       F.lit(LEHMER_MODULUS).cast("bigint"))
    return value


def lehmer_sql(key: str, stream: int = 0) -> str:
    """The same number as SQL text, for engines other than Spark."""
    text = f"(({key}) + {7919 * (stream + 1)}) % {LEHMER_MODULUS}"
    for factor in LEHMER_FACTORS:
        text = f"((({text}) * {factor}) + 104729) % {LEHMER_MODULUS}"
    return f"({text})"


def unit_interval(key: Column, stream: int = 0) -> Column:
    """Pseudo-random double in [0, 1)."""
    return lehmer(key, stream).cast("double") / F.lit(float(LEHMER_MODULUS))
