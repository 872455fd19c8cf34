"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int = 4) -> frozenset:
    w = SPACED.findall(low(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows: list[tuple[int, str | None]], threshold: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest id that links reach), by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    having: dict = {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    for i, s in sets.items():
        both = Counter(j for g in s for j in having[g] if j < i)
        for j, n in both.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contaminated(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple]:
    windows: dict = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w, hit, names = ALNUM.findall(low(text)), set(), set()
        for k in {len(x) for x in windows}:
            for at in range(len(w) - k + 1):
                if found := windows.get(tuple(w[at : at + k])):
                    hit.update(range(at, at + k))
                    names |= found
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(digits: str) -> bool:
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def base_spans(text: str) -> tuple[list[int], str]:
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x.lstrip("0")[:4] or "0") <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    counts = [sum(f[1] == k for f in found) for k in range(4)]
    return counts, hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(found)).encode()).hexdigest()


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = SPACED.findall(text)
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for d in range(3)}
    seen, equal = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            equal += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), equal, len(covered)


def licenses(text: str | None, templates, phrases, percent: int = 80) -> tuple:
    lowered = low(text)
    w, starts, labels = ALNUM.findall(lowered), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    found, score = set(labels), 1.0 if labels else 0.0
    for line in lowered.split("\n"):
        have = set(ALNUM.findall(line))
        for template, label in templates:
            t = set(template.split())
            if len(t & have) >= -(-percent * len(t) // 100):
                found.add(label)
                score = max(score, len(t & have) / len(t))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(found)), score
