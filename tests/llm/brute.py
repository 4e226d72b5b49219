"""Definitions of the operators' results, spelled out on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    places = {i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1}
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), failed


def dedup_words(rows, size=50):
    docs = [(d if d is not None else LAST, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            least[g] = min(least.get(g, LAST + 1), d)
    out = []
    for (d, w), (own, _) in zip(docs, rows, strict=True):
        gone = {i + k for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < d for k in range(size)}
        out.append((own, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def dedup_bytes(rows, size=200):
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def components(rows):
    docs = [(d if d is not None else LAST, shingles(t)) for d, t in rows]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            b = docs[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), LAST), d)
    null = lambda x: None if x == LAST else x
    return [(null(d), len(s), null(least[find(i)])) for i, (d, s) in enumerate(docs)]


def contamination(rows, items, size=13):
    patterns = {}
    for name, text in items:
        w = FOLD.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            patterns.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    lengths = {len(p) for p in patterns}
    out = []
    for d, t in rows:
        w = FOLD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in patterns:
                    hit |= set(range(i, i + n))
                    found |= patterns[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)

    return [(kind, m.start(), m.end()) for kind, p in PII for m in re.finditer(p, text or "") if ok(kind, m.group())]
