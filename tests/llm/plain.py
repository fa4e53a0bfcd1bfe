"""Plain forms of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def line_dedup(docs):
    """{id: (kept text, lines dropped)}; ids are unique."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), ())) < 2 or i == min(h)]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def bag(text: str) -> Counter:
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def near_classes(docs):
    """{id: smallest id of its class}; ids are unique."""
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = {i: bag(t or "") for i, t in docs}
    for a, ta in docs:
        for b, tb in docs:
            if a < b and ta is not None and tb is not None:
                shared = sum((bags[a] & bags[b]).values())
                if ta == tb or (shared and shared >= 0.8 * sum((bags[a] | bags[b]).values()) - 1e-9):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i, _ in docs}


def suffix_dedup(docs, length, keep_first):
    """{id: (bytes kept, bytes removed, runs removed)}; ids are unique."""
    at = defaultdict(list)
    data = {i: (t or "").encode() for i, t in docs}
    for i, t in data.items():
        for s in range(len(t) - length + 1):
            at[t[s : s + length]].append((i, s))
    out = {}
    for i, t in data.items():
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            places = at[t[s : s + length]]
            if len(places) > 1 and not (keep_first and min(places) == (i, s)):
                gone[s : s + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), runs)
    return out
