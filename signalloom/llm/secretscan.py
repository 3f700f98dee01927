"""Secret scans with a random forest that removes false positives.

Candidates are long tokens with a digit, and any tokens given to a credential's name, found by one regular expression over
every whole text. Each gets features: its
length, character transitions, coverage by dictionary words, its path, and words beside it. A random forest trained on
labelled findings then tells secrets from hashes, numbers, addresses and the like.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.common import cut, text_of

_IN = r"A-Za-z0-9_+/=.@\-"
#: A token of 12 or more characters with a digit anywhere in it.
LONG = rf"(?<![{_IN}])(?=[{_IN}]{{12}})(?=[A-Za-z_+/=.@\-]*+[0-9])[{_IN}]{{12,}}"
#: Any token of 4 or more characters right after a credential's name and an assignment sign, each maybe quoted.
#: The look back to a name tries every length at a place, so single characters and the sign are looked for first.
GIVEN = (r"(?<=[=:>\"'` \t])" + rf"(?=[^=])(?=[{_IN}]{{4}})" + r"(?<=[=:>][ \t]{0,3}[\"'`]?)"
         r"(?<=(?i:token|secret|password|passwd|passphrase|pwd|api.?key|auth|bearer|credential|credentials|private.?key)"
         r"[\"'`]?[ \t]{0,3}(?:=|:|:=|=>)[ \t]{0,3}[\"'`]?)(?<![=:>][=])" + rf"[{_IN}]{{4,}}")
CANDIDATE = rf"(?:{LONG}|{GIVEN})"
#: Characters of a text beside a candidate that are looked at for the words beside it.
REACH = 280
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private)"
HARMLESS = r"(?i)(example|sample|dummy|test|sha|md5|hash|commit|checksum|uuid|phone|card|mail|version)"
#: A name with an assignment sign at the head of a token.
NAME = r"^([A-Za-z_][A-Za-z0-9_.\-]{0,63}=+)([^=].*)$"
#: A credential name whose value follows; the name of a hash that follows; a login of an address whose password follows.
NAMED, HASHED, LOGIN = rf"{CREDENTIAL}[A-Za-z0-9_.\-]{{0,32}}[\"'`]?\s*[=:]+\s*[\"'`]?$", r"(?i)(sha-?[0-9]*|md5|hash|commit|checksum|uuid)[\"'`]?\s*[=:]*\s*[\"'`]?$", r"://[^\s/@]*:$"
#: Heads of keys that services give out.
ISSUED = r"^(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sprk]k[_-]|A[KS]IA|AIza|eyJ)"
#: Bits a character from which a token of 16 or more letters and digits may be random.
SURPRISING = 3.0
DICTIONARY, SAMPLE, TREES, DEPTH = 512, 20_000, 20, 6


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id_col, path, nth, candidate, before, after`` of every match of ``CANDIDATE``, whatever it is glued to.

    ``before`` is what is glued to it and up to three words (since the one before), ``after`` what is glued to it and up
    to two words; runs of blanks are one space, and at most ``REACH`` characters count. A name and ``=`` at the head of a
    match belong to ``before`` if the rest is a candidate by itself or the name is a credential's. Null texts have none.
    """
    text, reach = text_of(text_col), F.lit(REACH)
    spaced = lambda x: F.regexp_replace(x, r"\s+", " ")
    # A text's pieces between candidates are one more than its candidates.
    ends = F.transform(F.split(text, CANDIDATE), lambda x: F.struct(F.left(x, reach).alias("head"), F.right(x, reach).alias("tail")))
    hits = docs.where(text.rlike(CANDIDATE)).select(id_col, F.col(path_col).alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"), ends.alias("e"))
    size = F.size("c")
    part = lambda x, start, name: F.slice(x, F.lit(start), size).alias(name)
    parts = [F.col("c").alias("candidate"), part(F.col("e.tail"), 1, "tail"), part(F.col("e.head"), 2, "h1"), part(F.col("c"), 2, "c1"), part(F.col("e.head"), 3, "h2"), part(F.col("c"), 3, "c2")]
    each = hits.select(id_col, "path", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(parts, ("candidate", "tail", "h1", "c1", "h2", "c2"), strict=True)])).alias("nth", "f"))
    # The words after may be candidates themselves; a head that is cut short ends there.
    further = F.when(F.length("f.h1") < REACH, F.concat(F.coalesce("f.c1", F.lit("")), F.coalesce("f.h2", F.lit("")), F.coalesce(F.when(F.length("f.h2") < REACH, F.col("f.c2")), F.lit(""))))
    after = F.left(F.concat("f.h1", F.coalesce(further, F.lit(""))), reach)
    token, value = F.col("f.candidate"), F.regexp_extract("f.candidate", NAME, 2)
    named = F.regexp_extract("f.candidate", NAME, 1).rlike(CREDENTIAL) & (F.length(value) >= 4)
    split = value.rlike(rf"^{LONG}$") | named
    before = F.substring_index(spaced(F.col("f.tail")), " ", -4)
    return each.select(
        id_col, "path", "nth", F.when(split, value).otherwise(token).alias("candidate"),
        F.when(split, F.concat(before, F.regexp_extract("f.candidate", NAME, 1))).otherwise(before).alias("before"), F.substring_index(spaced(after), " ", 3).alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent lower-case words of 4 to 12 letters, over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(r"(?<!\p{L})[a-z]{4,12}(?!\p{L})"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return [r["word"] for r in top.collect()]  # bounded by size


def featured(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with ``f_*`` columns."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: (F.regexp_count(c, F.lit(pattern)) / n)
    characters = F.split(c, "")
    surprise = F.aggregate(F.transform(F.array_distinct(characters), lambda x: F.size(F.filter(characters, lambda y: y == x)) / n), F.lit(0.0),
                           lambda acc, q: acc - q * F.log2(q))
    known = F.lit(0.0)
    if words:
        pattern = "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"
        known = 1 - F.length(F.regexp_replace(F.lower(c), pattern, "")) / n
    yes = lambda column, pattern: F.coalesce(F.col(column).rlike(pattern), F.lit(False)).cast("double")
    return found.withColumns({
        "f_length": n, "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_hex": yes("candidate", "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "f_digits_only": yes("candidate", "^[0-9]+$"), "f_address": yes("candidate", "@|^[0-9.]+$"), "f_letter_to_digit": share("[A-Za-z](?=[0-9])"),
        "f_digit_to_letter": share("[0-9](?=[A-Za-z])"), "f_case_change": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "f_symbol": share("[^A-Za-z0-9]"),
        "f_repeat": share(r"(.)(?=\1)"), "f_surprise": surprise, "f_dictionary": known, "f_path_length": F.coalesce(F.length("path"), F.lit(0)).cast("double"),
        "f_path_depth": F.coalesce(F.regexp_count("path", F.lit("[/.]")), F.lit(0)).cast("double"), "f_path_test": yes("path", HARMLESS),
        "f_credential_before": yes("before", CREDENTIAL), "f_assigned": yes("before", r"[=:]\s*[\"']?$"), "f_quoted": yes("before", "[\"'`]$"),
        "f_harmless_before": yes("before", HARMLESS), "f_credential_after": yes("after", CREDENTIAL), "f_harmless_after": yes("after", HARMLESS),
    })


def known_findings(found: DataFrame) -> DataFrame:
    """Labelled findings from formats that are sure: ``label`` 1 for a hexadecimal or mixed token of 20 or more that is
    assigned to a credential name, 0 for digits, addresses, named hashes, and tokens without a credential name that
    don't look like keys; others are left out. ``found`` has features."""
    c, before = F.col("candidate"), F.col("before")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    strong = (F.length(c) >= 20) & mixed & ~c.rlike("@")
    alike = c.rlike(ISSUED) | before.rlike(LOGIN)
    random = mixed & ~c.rlike("@") & (F.length(c) >= 16) & (F.col("f_surprise") >= SURPRISING)
    plain = c.rlike("@|^[0-9.]+$") | before.rlike(HASHED) | ~random
    label = F.when(strong & before.rlike(NAMED), 1.0).when(~alike & (c.rlike("@|^[0-9.]+$") | (plain & ~before.rlike(CREDENTIAL))), 0.0)
    return found.withColumn("label", label).where(F.col("label").isNotNull())


def fit(labelled: DataFrame, sample: int = SAMPLE, key: tuple[str, ...] = ("doc_id", "nth")):
    """Forest on at most ``sample`` labelled findings with features (smallest hash of their key), or the share of label
    1 where there are fewer than two classes."""
    rows = labelled.orderBy(F.xxhash64(*key), *key).limit(sample)
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return (seen.get(1.0, 0) + 0.0) / max(1, sum(seen.values()))
    inputs = [c for c in labelled.columns if c.startswith("f_")]
    prepared = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(prepared)


def scored(found: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """``found`` with features replaced by ``score`` and ``is_secret``."""
    kept = [c for c in found.columns if not c.startswith("f_")]
    if isinstance(model, float):
        out = found.withColumn("score", F.lit(model))
    else:
        inputs = [c for c in found.columns if c.startswith("f_")]
        out = model.transform(VectorAssembler(inputCols=inputs, outputCol="features").transform(found)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*kept, "score").withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate of every whole text with its score.

    ``findings``: labelled rows like those of ``candidates`` plus ``label``; by default those of known formats. Null
    ids, paths and texts, repeated rows and empty tables are taken as they come; a candidate's words beside it may be
    empty; candidates and texts may be of any length. Ties of scores stay ties. Other columns are not read.
    """
    docs = docs.select(id_col, text_col, path_col)
    words = dictionary(docs, text_col)
    found = cut(featured(candidates(docs, id_col, text_col, path_col), words))
    labelled = known_findings(found) if findings is None else featured(findings, words)
    return scored(found, fit(labelled, key=(id_col, "nth")))
