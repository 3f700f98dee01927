"""Small numeric and contextual column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Inclusive age buckets.
AGE_BUCKETS = [
    (13, 17, "13-17"), (18, 24, "18-24"), (25, 34, "25-34"), (35, 44, "35-44"), (45, 54, "45-54"),
    (55, 64, "55-64"), (65, None, "65+"),
]
# The categories the first model generation knows.
KNOWN_CATEGORIES = [
    "FOOD", "SPORT", "MUSIC", "TECH", "GAMING", "TRAVEL", "COMEDY", "NEWS", "FASHION", "FITNESS",
]
MAX_AGE_HOURS = 24 * 365.0
MAX_LIVE_AGE_MINUTES = 1440.0
PERSONALISED_FROM = 10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def affinity(raw: Column | str) -> Column:
    return F.round(1 / (1 + F.exp(-_col(raw) / 10)), 6)


def watch_percentage(watch: Column | str, duration: Column | str) -> Column:
    w, d = _col(watch), _col(duration)
    return F.when(w.isNotNull() & (F.coalesce(d, F.lit(0.0)) != 0), F.round(w / d * 100, 4))


def normalize_region(c: Column | str) -> Column:
    v = F.upper(F.trim(_col(c)))
    return F.when(v != "", v)


def safe_region(c: Column | str) -> Column:
    v = normalize_region(c)
    return F.when(F.length(v) <= 8, v)


def age_bucket(c: Column | str) -> Column:
    age, out = _col(c), None
    for low, high, label in AGE_BUCKETS:
        hit = (age >= low) if high is None else age.between(low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def age_from_birthday(birthday: Column | str, as_of: Column | str) -> Column:
    """Whole years; NULL for a future birthday or an age outside 0..120."""
    b, t = _col(birthday), F.to_date(_col(as_of))
    early = (F.month(t) * 100 + F.dayofmonth(t)) < (F.month(b) * 100 + F.dayofmonth(b))
    age = F.year(t) - F.year(b) - early.cast("int")
    return F.when((b <= t) & age.between(0, 120), age)


def sanitize(c: Column | str) -> Column:
    v = _col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def unit_hash(*parts: Column) -> Column:
    """First 8 bytes of sha256 of the parts joined by ``|``, over 2^64."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def half_life_decay(age: Column, half_life: float) -> Column:
    return F.exp(F.when(age < 0, 0.0).otherwise(age) * (-math.log(2) / half_life))


def strategy(evidence: Column | str) -> Column:
    n = _col(evidence)
    return F.when(n == 0, "COLD_START").when(n < PERSONALISED_FROM, "HYBRID").otherwise("PERSONALISED_ML")


def age_hours(created_us: Column, at_us: Column) -> Column:
    return F.least(F.lit(MAX_AGE_HOURS), F.greatest(F.lit(0.0), (at_us - created_us) / 3.6e9))


def live_age_minutes(created_us: Column, at_us: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(MAX_LIVE_AGE_MINUTES), (at_us - created_us) / 6.0e7))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(0.0)


def legacy_category(primary: Column, mapped: Column) -> Column:
    """Known categories pass; else the versioned mapping (joined in by the caller); else UNKNOWN."""
    return F.when(primary.isin(KNOWN_CATEGORIES), primary).when(
        primary.isNotNull(), F.coalesce(mapped, F.lit("UNKNOWN"))
    ).otherwise("UNKNOWN")
