"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def documents(spark, rows):
    """A table of documents with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(d, t, "en", None if d is None else f"src{d % 3}", None, 1, "k", 0.5) for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n double")


def whole(value):
    """None for null, whichever way pandas gave it."""
    return None if value is None or value != value else int(value)


def reference_tokens():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(rows, n, num, den):
    """(doc_id, shingles, component) per row; null ids are last in order."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, k in shared.items():
            if k * den >= (len(s) + len(sets[j]) - k) * num:
                parent[find(i)] = find(j)
    least = {}
    last = 1 << 63
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), last), last if d is None else d)
    return [(d, len(sets[i]), None if least[find(i)] == last else least[find(i)]) for i, (d, _) in enumerate(rows)]


def without_repeats(rows, window=20):
    """(doc_id, words, removed, kept text) per row; null ids are first in order."""
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (d, t, s)) != (d, t, s):
                gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def exact_groups(rows):
    """(doc_id, keep_id, size, kept) per row; null ids are last in order."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for ids in groups.values():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        out += [(d, keep, len(ids), d == keep) for d in ids]
    return out


def exact_keepers(rows):
    """The id that stays of each group of equal texts."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return [min((d for d in ids if d is not None), default=None) for ids in groups.values()]


def top_k(rows, k, is_query):
    """(query_id, rank, vec_id, score)."""
    out = []
    for q, v in rows:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def word_runs(words, least, times):
    """(start, length, period) of every run, by start, then period, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_row(doc_id, text):
    """A row of the query of periodic runs."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = word_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
