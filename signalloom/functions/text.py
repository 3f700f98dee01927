"""Text normalization that needs Unicode tables: small Arrow helpers, everything else built in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

LANGUAGE_TAG = r"^[a-z]{2,3}(-[a-z0-9]{2,8})*$"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    """NFC then NFKD without combining marks, case-folded."""

    def one(t):
        if t is None:
            return None
        decomposed = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", t))
        return "".join(ch for ch in decomposed if not unicodedata.combining(ch)).casefold()

    return s.map(one)


def _needs_unicode(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def collapse(c: Column) -> Column:
    """Whitespace runs to one space, trimmed, blank to NULL."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def normalize_text(c: Column) -> Column:
    """NFC, collapsed whitespace; ASCII text never leaves the JVM's own expressions."""
    return collapse(F.when(_needs_unicode(c), _nfc(F.when(_needs_unicode(c), c))).otherwise(c))


def fold(c: Column) -> Column:
    """Collapsed text without diacritics and case."""
    t = collapse(c)
    return F.when(_needs_unicode(t), _fold(F.when(_needs_unicode(t), t))).otherwise(F.lower(t))


def fingerprint(title: Column, folded_tags: Column) -> Column:
    """sha256 over the folded title and the sorted set of folded, non-empty tags."""
    tags = F.array_join(F.array_sort(F.filter(F.array_distinct(folded_tags), lambda t: t.isNotNull() & (t != ""))), ",")
    body = F.concat(F.lit("title:"), F.coalesce(fold(title), F.lit("")), F.lit("|hashtags:"), F.coalesce(tags, F.lit("")))
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def fold_tags(tags: Column | str) -> Column:
    """Each tag of a short list folded; lists of ASCII tags never leave the JVM's own expressions."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    known = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull())
    other = F.exists(known, _needs_unicode)
    return F.when(other, _fold_tags(F.when(other, tags))).otherwise(F.transform(known, lambda t: F.coalesce(F.lower(collapse(t)), F.lit(""))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_tags(s: pd.Series) -> pd.Series:

    def one(t):
        decomposed = unicodedata.normalize("NFKD", " ".join(unicodedata.normalize("NFC", t).split()))
        return "".join(ch for ch in decomposed if not unicodedata.combining(ch)).casefold()

    return s.map(lambda tags: [] if tags is None else [one(t) for t in tags if t is not None])


def language_tag(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin("mixed", "unknown") | v.rlike(LANGUAGE_TAG), v)


def language_error(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when((v != "") & language_tag(c).isNull(), "BAD_LANGUAGE")
