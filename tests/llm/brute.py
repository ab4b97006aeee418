"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def fingerprint(text, shingle=3, seed=42):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, tau=3):
    """{doc_id: least doc_id reachable} from {doc_id: fingerprint}."""
    forest = Forest()
    ids = sorted(prints)
    for i, a in enumerate(ids):
        forest.find(a)
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= tau:
                forest.join(a, b)
    return {a: forest.find(a) for a in ids}


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]
