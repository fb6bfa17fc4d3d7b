"""Plain Python forms of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def private(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for no, (kind, expression) in enumerate(EXPRESSIONS.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), no, m.end()))
    return sorted(out)


def letters(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = letters(text)
        size = min(13, len(words))
        for j in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[j : j + size])].add(str(item))
    out = []
    for doc, text in docs:
        words = letters(text)
        hit, found = [0] * len(words), set()
        for size in {len(w) for w in windows}:
            for j in range(len(words) - size + 1):
                if own := windows.get(tuple(words[j : j + size])):
                    found |= own
                    hit[j : j + size] = [1] * size
        n = sum(hit)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), n, len(found), digest, n > 0 and 20 * n >= len(words)))
    return out


def shingles(text: str | None) -> frozenset:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near(docs, percent=85):
    """(id, size, least id reachable) of each document; ids are distinct."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, own in sets.items():
        for s in own:
            holders[s].append(d)
    both = Counter()
    for own in holders.values():
        for i, x in enumerate(own):
            for y in own[:i]:
                both[x, y] += 1
    for (x, y), n in both.items():
        if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(docs):
    """(n_bytes, n_removed, n_spans, digest of the rest) of each (id, text)."""
    first = {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], d)
    out = []
    for d, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
