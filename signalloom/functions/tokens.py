"""Semantic tokens: normalization and the five token fields, with built-in array functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that never become title tokens.
TITLE_STOP_WORDS = [
    "AND", "THE", "OF", "A", "AN", "TO", "IN", "ON", "WITH", "FOR", "AT", "BY", "IS", "IT", "AS", "OR",
    "FROM", "VS", "BEST", "ROAD", "FINAL", "NEW", "TOP", "LIVE", "HIGHLIGHTS", "MOMENTS", "GREATEST",
]
MAX_TOKENS = 15
MAX_TOKEN_LENGTH = 40
MAX_TITLE_LENGTH = 200
MAX_TITLE_TOKENS = 8
FIELDS = ["hashtag", "topic", "entity", "subgenre", "title"]
# Python's str.strip() set restricted to ASCII, as a regex class.
_WS = r"[ \t\n\r\f\x0B\x1C-\x1F]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def normalize_token(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), "^#+", "")
    return F.upper(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def normalize_tokens(c: Column) -> Column:
    """Ordered distinct normalized tokens; NULL in, empty out."""
    return F.coalesce(F.array_distinct(F.transform(c, normalize_token)), F.array().cast("array<string>"))


def token_list_error(c: Column) -> Column:
    """Why a raw list is rejected, or NULL."""
    return (
        F.when(F.size(c) > MAX_TOKENS, "TOO_MANY")
        .when(F.exists(c, lambda t: strip(t) == ""), "BLANK")
        .when(F.exists(c, lambda t: normalize_token(t) == ""), "EMPTY_TOKEN")
        .when(F.exists(c, lambda t: F.length(normalize_token(t)) > MAX_TOKEN_LENGTH), "TOO_LONG")
    )


def normalize_title(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def title_error(c: Column) -> Column:
    return F.when(F.length(strip(c)) > MAX_TITLE_LENGTH, "TITLE_TOO_LONG")


def title_tokens(c: Column) -> Column:
    """First eight ordered-distinct words of the whole title, stop words dropped."""
    words = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+"), F.upper),
        lambda w: (w != "") & ~w.isin(TITLE_STOP_WORDS),
    )
    return F.slice(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, MAX_TOKEN_LENGTH))), 1, MAX_TITLE_TOKENS)


def decode_token_list(c: Column) -> Column:
    """JSON text to array; NULL, corrupt or non-list text gives an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _distinct(c: str) -> Column:
    return F.coalesce(F.array_distinct(F.col(c)), F.array().cast("array<string>"))


def _placed(k: int):
    """Token and its index -> struct, positioned after the earlier fields."""

    def place(token: Column, index: Column) -> Column:
        return F.struct(
            F.lit(FIELDS[k]).alias("field"), (F.lit(k * 1000) + index).cast("int").alias("pos"), token.alias("token"))

    return place


def token_fields() -> Column:
    """array<struct<field, pos, token>> over hashtags, topics, entities, subgenres and title words."""
    lists = [_distinct("hashtags"), _distinct("topics"), _distinct("entities"), _distinct("subgenres"),
             title_tokens(F.col("title"))]
    parts = [F.transform(tokens, _placed(k)) for k, tokens in enumerate(lists)]
    return F.concat(*parts)


def all_tokens() -> Column:
    """Distinct tokens over every field (field identity dropped)."""
    return F.array_distinct(F.transform(token_fields(), lambda s: s["token"]))


def token_parts(tokens: Column) -> Column:
    """Distinct non-empty underscore parts of the tokens."""
    return F.array_distinct(F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "_"))), lambda p: p != ""))
