"""Plain-Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def quality(text):
    t = text or ""
    w = SPACE_WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed)


def decontaminate(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        if w:
            for i in range(max(len(w) - 13, 0) + 1):
                windows[tuple(w[i : i + 13])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = word.findall(lower(text or ""))
        hit, own = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    own |= found
        out.append((doc, len(w), len(hit), len(own), sha(",".join(sorted(map(str, own))).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def linededup(docs):
    def key(line):
        k = line.strip(" \t\n\v\f\r")
        return lower(k) if len(k) >= 10 else None

    first = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if (k := key(line)) is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if (k := key(x)) is None or first[k] == doc]
        out.append((doc, len(lines), len(lines) - len(keep), sha("\n".join(keep).encode())))
    return out


def substrings(docs, length=400):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter()
    for _, t in raw:
        seen.update(hash(t[i : i + length]) for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        end = 0
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def shingles(text, n=5):
    w = SPACE_WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1))


def jaccard(docs, percent=80):
    sets = [(d, shingles(t)) for d, t in docs]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for own in where.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            top[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]


def chats(rows):
    """rows: (conv, turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = []
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        out.append((c, len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own).encode()), len(loss), sha(loss.encode())))
    return out
