"""Plain Python versions of the contracts, over rows (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substrings(rows, window=20):
    first, out = {}, {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), (doc, k))
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] != (doc, k):
                gone[k : k + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingle_groups(rows, n, num, den):
    """doc -> (set size, smallest reachable doc, linked sets)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text in rows:
        words = WORD.findall((text or "").translate(lower))
        sets[doc] = frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def unite(a, b):
        a, b = sorted((root(a), root(b)))
        up[b] = a

    by_set = defaultdict(list)
    for doc, s in sets.items():
        if s:
            by_set[s].append(doc)
    kinds, where, links = list(by_set), defaultdict(list), Counter()
    for docs in by_set.values():
        for d in docs[1:]:
            unite(docs[0], d)
    for k, s in enumerate(kinds):
        both = Counter(j for g in s for j in where[g])
        for j, n_both in both.items():
            if den * n_both >= num * (len(s) + len(kinds[j]) - n_both):
                links[k] += 1
                links[j] += 1
                unite(by_set[s][0], by_set[kinds[j]][0])
        for g in s:
            where[g].append(k)
    of = {s: links[k] for k, s in enumerate(kinds)}
    return {d: (len(s), root(d), of.get(s, 0)) for d, s in sets.items()}


def spans(text, patterns):
    """(start, rank, end) of leftmost matches that pass, for (pattern, test) in rank order."""
    return sorted((m.start(), rank, m.end()) for rank, (pattern, test) in enumerate(patterns) for m in re.finditer(pattern, text) if test(m))


def distance_within(item, text, budget):
    """Least edit distance of item to any stretch of text, or None over the budget."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row) if min(row) <= budget else None


def splits(sizes, limit):
    """Extendible hashing over (bits, bytes): leaf prefix -> bytes; prefixes that can't be split stay over the limit."""
    out, todo = {}, [""]
    while todo:
        p = todo.pop()
        total = sum(b for bits, b in sizes if bits.startswith(p))
        if total <= limit or len(p) == 64:
            out[p] = total
        else:
            todo += [p + "0", p + "1"]
    return out
