"""How far the word use of sources differs from each other and from their language, by iceberg prefix refinement.

Terms are runs of letters: ASCII letters, lower-cased, and everything beyond ASCII. A language keeps the terms that enough
of its documents hold. Most distinct terms are rare, so they are never counted as such:

1. Byte prefixes of terms are counted per language, each document once: first short ones, then longer ones. A prefix that
   too few documents hold is discarded, and with it, in the next level, every term that begins so.
2. When no live term goes beyond the level's length, the terms that are left are counted whole, per source, and the
   threshold decides on whole terms.

Counts of a task's documents add up before they are shuffled. The live prefixes of a level go to the tasks as a filter of
bounded size: with more live prefixes than it can hold it discards less, and the counts of later levels stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.llm.common import cut
from signalloom.llm.recurring import bits_for, key_filter, may_hold
from signalloom.llm.wordhash import blocks, mixed, names_of, raw_bytes, words_of

#: Bytes of text handled at once, first prefix length and its growth a level (a level reads every text, so there are few), and the largest filter (2 ** 27 bits: 16 MB).
BLOCK, FIRST, GROWTH, MOST_BITS = 8 << 20, 8, 4, 27
_NOT_IN_TERMS = np.array([b < 0x80 and not (65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])


def _names(column: pa.Array) -> np.ndarray:
    return names_of(column.cast(pa.large_binary()))[:, 0]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and where each begins in the sorted values (one entry more)."""
    values = np.sort(values)
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[begin], np.r_[begin, len(values)]


def _numbers(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _terms(batch: pa.RecordBatch, of_row: np.ndarray, of_lang: np.ndarray, lang: np.ndarray, length: int, held) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: distinct terms; and of each occurrence of a live one its document, group and term, by number.
    ``of_row`` has the group of each row, ``of_lang`` its language, ``lang`` the hash of each language."""
    data, offsets = raw_bytes(batch.column("text"))
    for a, b in blocks(offsets, BLOCK):
        words = words_of(data, offsets[a : b + 1], lower=True, separators=_NOT_IN_TERMS)
        if not len(words.start):
            continue
        doc = np.repeat(np.arange(a, b), words.counts)
        term, of = words.ids, of_row[doc]
        if held is not None:
            prefix = _names(pc.binary_slice(words.distinct, 0, length))
            if len(lang) * len(prefix) <= 2 * len(term):  # a table is less work than the words one by one
                live = may_hold(held.value, mixed(lang[:, None] ^ prefix).ravel())[of_lang[doc] * len(prefix) + term]
            else:
                live = may_hold(held.value, mixed(lang[of_lang[doc]] ^ prefix[term]))
            doc, term, of = doc[live], term[live], of[live]
        yield words.distinct, doc, of, term


def _prefixes(length: int, before: int, held):
    """Rows (key, docs, longer): documents of this task's part with a live term that begins so, by language and prefix."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row, langs = _numbers(batch.column("lang"))
            lang = mixed(_names(langs))
            keys, docs, longer = [], [], []
            for distinct, doc, of, term in _terms(batch, of_row, of_row, lang, before, held):
                cut_off = pc.binary_slice(distinct, 0, length).dictionary_encode()
                prefix, names = cut_off.indices.to_numpy(zero_copy_only=False).astype(np.int64), _names(cut_off.dictionary)
                goes_on = np.zeros(len(names), bool)
                goes_on[prefix[pc.binary_length(distinct).to_numpy(zero_copy_only=False) > length]] = True
                size = len(lang) * len(names)
                once, _ = _runs(doc * size + of * len(names) + prefix[term])
                group, begin = _runs(once % size)
                n = np.diff(begin)
                keys.append(mixed(lang[group // len(names)] ^ names[group % len(names)]))
                docs.append(n)
                longer.append(goes_on[group % len(names)])
            if keys:
                key = np.concatenate(keys)
                order = np.argsort(key)
                key, begin = _runs(key[order])
                n, more = (f.reduceat(np.concatenate(c)[order], begin[:-1]) for f, c in ((np.add, docs), (np.logical_or, longer)))
                for a in range(0, len(key), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(n[part]), pa.array(more[part])], names=["key", "docs", "longer"])

    return over


def _counts(before: int, held):
    """Rows (lang, source, term, docs, n) of live terms, summed over this task's batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (of_lang, langs), (of_source, sources) = _numbers(batch.column("lang")), _numbers(batch.column("source"))
            groups_here = len(langs) * len(sources)
            for distinct, doc, of, term in _terms(batch, of_lang * len(sources) + of_source, of_lang, mixed(_names(langs)), before, held):
                key = of * len(distinct) + term
                size = groups_here * len(distinct)
                once, begin = _runs(doc * size + key)
                order = np.argsort(once % size)
                groups, first = _runs((once % size)[order])
                docs, n = np.diff(first), np.add.reduceat(np.diff(begin)[order], first[:-1])
                for a in range(0, len(groups), 1 << 16):
                    k = groups[a : a + (1 << 16)]
                    own = k // len(distinct)
                    yield pa.RecordBatch.from_arrays([
                        langs.take(pa.array(own // len(sources))), sources.take(pa.array(own % len(sources))), distinct.take(pa.array(k % len(distinct))).cast(pa.binary()).cast(pa.string()),
                        pa.array(docs[a : a + (1 << 16)].astype(np.int64)), pa.array(n[a : a + (1 << 16)].astype(np.int64))], names=["lang", "source", "term", "docs", "n"])

    return over


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("text", text_col), ("lang", lang_col), ("source", source_col))))


def kept_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, term, n, by_source``: occurrences of each term that at least ``least`` rows of its language hold, in the
    language and in each source that has it (an array of source, n; at most one entry a source)."""
    rows = _rows(docs, text_col, lang_col, source_col)
    before, held, length, more = 0, None, FIRST, True
    while more:
        counted = rows.select("lang", "text").mapInArrow(_prefixes(length, before, held), "key long, docs long, longer boolean")
        live = cut(counted.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("longer").alias("longer")).where(F.col("docs") >= least))
        n, more = live.agg(F.count(F.lit(1)), F.coalesce(F.max("longer"), F.lit(False))).first()
        before, length, held = length, GROWTH * length, key_filter(live, bits=bits_for(n, MOST_BITS))
    whole = rows.mapInArrow(_counts(before, held), "lang string, source string, term string, docs long, n long")
    sums = whole.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    by_term = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    return by_term.where(F.col("docs") >= least).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)), exactly."""
    above, below = (n + 2).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)"), (total + 2 * terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` of whole arrays, three digits at a time, so that no product leaves 64 bits. ``total`` includes the 2 a term."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, a, b, value): divergences of pairs of sources, by number, summed over the terms of a batch."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        order = np.argsort(np.array(langs, object), kind="stable") if langs else []
        a = 0
        while a < len(order):
            b = a
            while b < len(order) and langs[order[b]] == langs[order[a]]:
                b += 1
            total = np.array(batch.column("totals")[order[a]].as_py(), np.int64)
            sums = np.zeros((len(total), len(total)), np.int64)
            step = max(1, (1 << 21) // len(total))
            for s in range(a, b, step):
                held = batch.column("by_source").take(pa.array(order[s : min(b, s + step)]))
                count = np.zeros((len(held), len(total)), np.int64)
                flat = held.flatten()
                count[np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False)), pc.struct_field(flat, 0).to_numpy()] = pc.struct_field(flat, 1).to_numpy()
                p = np.ascontiguousarray(_shares(count, total).T)
                for i in range(len(total) - 1):  # one source against the later ones
                    x, y = p[i], p[i + 1 :]
                    sums[i, i + 1 :] += ((x - y) ** 2 // (x + y)).sum(1)
            for i in range(len(total) - 1):
                k = len(total) - 1 - i
                yield pa.RecordBatch.from_arrays([
                    pa.array([langs[order[a]]] * k, pa.string()), pa.array(np.full(k, i, np.int32)), pa.array(np.arange(i + 1, len(total), dtype=np.int32)), pa.array(sums[i, i + 1 :])],
                    names=["lang", "a", "b", "value"])
            a = b


def divergences(docs: DataFrame, least: int = 10, ranks: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) that occurs.

    Each group, and each language, gives every kept term a share of 10^9 that its count, plus two, has of all kept terms
    (plus one, rounded down). Part ``pair`` ranks the other sources of the language by triangular discrimination, the sum
    of (p - q)^2 / (p + q) over kept terms, each rounded down; 0 where the language keeps no term. Part ``term`` ranks the
    terms that the source uses more than its language, up to ``ranks``. Ties go to the lesser item in order of UTF-8.

    Null text, lang and source are ''. Every row is a document, also where rows or ids repeat; texts without terms leave
    their group in place; texts of any length are read whole. No rows in, no rows out; other columns are not read. All
    arithmetic is exact. ``pair`` has a row for each two sources of a language, so the sums of one language are held source
    by source: a row of ``by_source`` has at most one entry a source.
    """
    found = cut(kept_counts(docs, least, text_col, lang_col, source_col))
    groups = _rows(docs, text_col, lang_col, source_col).groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    each = found.select("lang", "term", F.explode("by_source").alias("x")).select("lang", "term", "x.source", "x.n")
    whole = found.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all"))
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = groups.join(whole, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["terms", "all", "total"])
    facts = cut(facts.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))

    listed = facts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("number", "source", (F.col("total") + 2 * F.col("terms")).alias("t")))).alias("s"))
    placed = found.join(listed, "lang").select("lang", F.col("s.t").alias("totals"), F.transform("by_source", lambda x: F.struct((F.array_position(F.col("s.source"), x["source"]) - 1).cast("int").alias("at"), x["n"].alias("n"))).alias("by_source"))
    sums = placed.mapInArrow(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    x, y = facts.select("lang", "source", F.col("number").alias("a")), facts.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = x.join(y, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("of_all"), F.col("all"), F.col("terms"))
    used = each.join(found.select("lang", "term", F.col("n").alias("of_all")), ["lang", "term"]).join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= ranks))
