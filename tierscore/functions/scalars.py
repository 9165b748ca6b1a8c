"""Small scalar expressions: labels, decision codes, segment keys, score bands, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision names with their numeric codes; any other code is bucket 4.
ALLOW, DENY, REVIEW, DEGRADE = "allow", "deny", "manual_review", "degrade_allow"
DECISION_CODES = {ALLOW: 0, DENY: 1, REVIEW: 2, DEGRADE: 3}
OTHER_BUCKET = 4

# Default score bands and the sampling unit.
UNCERTAIN_LOW, UNCERTAIN_HIGH = 0.35, 0.65
DENY_AT, REVIEW_AT = 0.85, 0.65
PPM = 1_000_000


def at_least(score: Column, threshold: Column) -> Column:
    """``score >= threshold`` with NaN and NULL counting as false."""
    return F.coalesce(~F.isnan(score) & (score >= threshold), F.lit(False))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def decision_label(l1_pass: Column, l2_reject: Column) -> Column:
    """Tier one passes to allow; otherwise the second tier denies or leaves it to review."""
    return (
        F.when(l1_pass, F.lit(ALLOW))
        .when(F.coalesce(l2_reject, F.lit(False)), F.lit(DENY))
        .otherwise(F.lit(REVIEW))
    )


def decision_code(label: Column) -> Column:
    code = F.lit(OTHER_BUCKET)
    for name, value in DECISION_CODES.items():
        code = F.when(label == name, F.lit(value)).otherwise(code)
    return code.cast("int")


def decision_bucket(code: Column) -> Column:
    return F.when(code.between(0, 3), code).otherwise(F.lit(OTHER_BUCKET)).cast("int")


def score_band(score: Column) -> Column:
    return (
        F.when(score >= DENY_AT, F.lit("deny"))
        .when(score >= REVIEW_AT, F.lit("review"))
        .when((score > UNCERTAIN_LOW) & (score < UNCERTAIN_HIGH), F.lit("uncertain"))
        .otherwise(F.lit("clear"))
    )


def _trim_decimal(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def segment_part(x: Column) -> Column:
    """Canonical text of one numeric segment column."""
    v = x.cast("double")
    infinite = F.abs(v) == F.lit(float("inf"))
    fraction = F.abs(v) - F.floor(F.abs(v))
    return (
        F.when(v.isNull() | F.isnan(v) | infinite, F.lit("NA"))
        .when(fraction <= 1e-9, v.cast("bigint").cast("string"))
        .otherwise(_trim_decimal(F.format_string("%.15f", v)))
    )


def segment_key(parts: Sequence[Column], explicit: Column | None = None) -> Column:
    """Parts joined by ``|``; an explicit segment number overrides them."""
    joined = F.concat_ws("|", *[segment_part(p) for p in parts]) if parts else F.lit("")
    if explicit is None:
        return joined
    return F.when(explicit.isNotNull(), explicit.cast("string")).otherwise(joined)


def canonical_key_text(text: Column) -> Column:
    """The same canonical form for a key read as text, part by part."""

    def one(part: Column) -> Column:
        t = F.trim(part)
        v = t.try_cast("double")
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 9.2e18)
        fraction = F.abs(v) - F.floor(F.abs(v))
        return (
            F.when(t == "", F.lit("NA"))
            .when(finite & (fraction <= 1e-12), v.cast("bigint").cast("string"))
            .otherwise(t)
        )

    return F.array_join(F.transform(F.split(text, r"\|"), one), "|")


def sampled_ppm(key: Column, ppm: int) -> Column:
    """Ratio sampling in parts per million, repeatable per key."""
    return F.pmod(F.xxhash64(key), F.lit(PPM)) < F.lit(int(ppm))


def every_nth(index: Column, n: int) -> Column:
    """Systematic sampling: every n-th row of a dense index."""
    return F.pmod(index, F.lit(int(n))) == 0


def fixed9(x: Column) -> Column:
    """Nine decimals; a missing score prints as NaN."""
    v = x.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit("NaN")).otherwise(F.format_string("%.9f", v))
