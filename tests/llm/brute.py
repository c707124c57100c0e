"""Plain Python versions of the contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def words(text: str | None, fold: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(FOLD) if fold else text or "")


def quality(text: str | None) -> tuple:
    w = words(text)
    spans = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered, seen, twice = Counter(spans), set(), set(), 0
    for i, s in enumerate(spans):
        if often[s] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered)


def removed(rows) -> list[tuple]:
    """Substring rule; a null id neither loses nor counts."""
    first: dict[tuple, int] = {}
    each = [(k, words(t)) for k, t in rows]
    for k, w in each:
        for i in range(len(w) - 49 if k is not None else 0):
            g = hash(tuple(w[i : i + 50]))
            first[g] = min(first.get(g, k), k)
    out = []
    for k, w in each:
        gone = bytearray(len(w))
        for i in range(len(w) - 49 if k is not None else 0):
            if first[hash(tuple(w[i : i + 50]))] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), sha(kept)))
    return out


_SECRET = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text: str | None) -> list[tuple]:
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in _SECRET.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def contamination(text: str | None, items) -> tuple:
    letters = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    w = letters(text)
    hit, found = set(), set()
    for item, t in items:
        b = letters(t)
        for i in range(max(len(b) - 12, 1) if b else 0):
            g = b[i : i + 13]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def near(rows) -> list[tuple]:
    """Components over an inverted index of all shingles; null ids and empty sets stand alone."""
    sets = []
    for _, t in rows:
        w = words(t, fold=True)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent: dict[int, int] = {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, (k, _) in enumerate(rows):
        met: Counter = Counter()
        for g in sets[i] if k is not None else ():
            met.update(holders.setdefault(g, []))
            holders[g].append(i)
        for j, same in met.items():
            if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                a, b = root(k), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return [(k, len(s), None if k is None else root(k), k is None or root(k) == k) for (k, _), s in zip(rows, sets, strict=True)]


def backoff(rows, alpha: float = 0.4) -> list[tuple]:
    each = [words(t, fold=True) for _, t in rows]
    count: Counter = Counter()
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for w in each:
        count.update(grams(w))
    total, out = sum(map(len, each)), []
    for (k, _), w in zip(rows, each, strict=True):
        own, others, score, level = grams(w), max(total - len(w), 1), 0.0, [0] * 4
        for i in range(len(w)):
            top = min(i + 1, 3)
            for n in range(top, -1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n and count[g] - own[g] > 0:
                    below = others if n == 1 else count[g[:-1]] - own[g[:-1]]
                    score += math.log((count[g] - own[g]) / below) + (top - n) * math.log(alpha)
                    break
                if not n:
                    score += math.log(alpha / others) + (top - 1) * math.log(alpha)
            level[n] += 1
        out.append((k, len(w), score, *level[::-1]))
    return out


def licences(text: str | None, sentences: dict[str, str], rules) -> tuple:
    """Identifiers in order, and the rules that find theirs in what earlier rules left."""
    name = {v: k for k, v in sentences.items()}
    found = []
    for part in re.split(r"[.!?;:][ \t\n\r\"')]+|[\n\r]+", text or ""):
        plain = " ".join(re.findall("[a-z0-9]+", part.translate(FOLD)))
        if plain in name:
            found.append(name[plain])
    left, out = list(found), []
    for licence, ids in rules:
        at = 0
        while True:
            places, j = [], at
            for i in ids:
                if i not in left[j:]:
                    break
                j = left.index(i, j) + 1
                places.append(j - 1)
            if len(places) < len(ids):
                break
            if licence not in out:
                out.append(licence)
            at = places[-1] + 1 - len(places)
            left = [x for i, x in enumerate(left) if i not in places]
    return ",".join(found), ",".join(out), len(found)
