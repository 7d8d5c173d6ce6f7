"""Plain versions of the operators over small lists of (doc_id, text), written from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text):
    return WORD.findall(text or "")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def window_removal(rows, width):
    """{(doc_id, text): (n_words, n_removed, sha of the kept words)}"""
    first = defaultdict(lambda: float("inf"))
    num = [(float("inf") if d is None else d, d, t) for d, t in rows]
    for key, _, t in num:
        w = word_list(t)
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            first[s] = min(first[s], key)
    out = {}
    for key, d, t in num:
        w = word_list(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key:
                gone.update(range(i, i + width))
        out[d, t] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def byte_removal(rows, width):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha of the rest)}"""
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d, t] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def fingerprint(text, k):
    w = word_list(lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, k, radius):
    """[(doc_id, fingerprint, component)]; ids that are missing count as the largest."""
    fps = [fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], float("inf") if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)]
        out.append((d, f"{fps[i]:016x}", None if c == float("inf") else c))
    return out


def longest_repeats(words_):
    """For each place the longest substring from there that occurs twice."""
    n = len(words_)
    best = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words_[i + k] == words_[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best
