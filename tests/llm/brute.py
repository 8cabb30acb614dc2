"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

import xxhash


class Sets:
    """Union-find."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)


def simhash(text: str | None, shingle: int = 4) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; only A-Z change case, all non-ASCII
    characters count as letters."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)


def shingles(words: list[str], k: int) -> list[tuple[str, ...]]:
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def jaccard(a: list[tuple], b: list[tuple]) -> float:
    ca, cb = Counter(a), Counter(b)
    w = lambda s: len(set(s)) / len(s)
    most = sum(w(s) * max(ca[s], cb[s]) for s in ca.keys() | cb.keys())
    return sum(w(s) * min(ca[s], cb[s]) for s in ca.keys() | cb.keys()) / most if most else 0.0


def leaks(doc: str | None, item: str | None) -> float:
    """Best similarity of an item with a window of its size."""
    words, other = words_of(doc), words_of(item)
    if not other:
        return 0.0
    k = min(5, len(other))
    a, b = shingles(words, k), shingles(other, k)
    m = len(b)
    return max((jaccard(a[i:i + m], b) for i in range(max(1, len(a) - m + 1))), default=0.0)


def dice(a: str, b: str) -> float:
    x, y = (Counter(shingles(words_of(t), 2)) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0
