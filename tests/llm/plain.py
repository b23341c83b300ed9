"""Brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def removed(docs, window=20):
    """docs: [(doc_id, text)] in order -> {doc_id: (n_words, n_removed, kept sha256)}."""
    seen, out = set(), {}
    for doc, text in docs:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc] = len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


def contaminated(docs, items, window=13):
    held, sizes = defaultdict(set), set()
    for item, text in items:
        w = TOKEN.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[i : i + window])].add(str(item))
            sizes.add(len(w[i : i + window]))
    out = {}
    for doc, text in docs:
        w, hit, found = TOKEN.findall((text or "").translate(LOW)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in held:
                    found |= held[k]
                    hit |= set(range(i, i + n))
        out[doc] = len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)
    return out


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict, radius=4):
    """{id: fingerprint} -> {id: smallest id reachable}."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def targets(sizes: dict, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        free -= set(over)
    return out


def nearest(vectors: dict, query: int, k=5):
    """[(id, cosine)], nearest first."""
    q = vectors[query]
    scored = [(-float(q @ v / np.sqrt((q @ q) * (v @ v))), i) for i, v in vectors.items() if i != query]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def viterbi(first, step, emit):
    score, back = first + emit[0], []
    for e in emit[1:]:
        paths = score[:, None] + step
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]
