"""The contracts in plain Python, without any of the operators' methods."""

import hashlib
import math
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    words = SPACED.findall((text or "").translate(FOLD))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)]))


def components(docs, percent=90, size=3):
    """docs: {doc_id: text} -> {doc_id: (set size, smallest linked doc_id)}"""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


def contamination(docs, items, window=13):
    wins = {}
    for item, text in items.items():
        words = WORDS.findall((text or "").translate(FOLD))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            wins.setdefault(tuple(words[i:i + m]), set()).add(str(item))
    lengths = {len(w) for w in wins}
    out = {}
    for d, text in docs.items():
        words, hit, found = WORDS.findall((text or "").translate(FOLD)), set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if (g := tuple(words[i:i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[g]
        out[d] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                  bool(hit) and 20 * len(hit) >= len(words))
    return out


def without_repeats(docs, depth=100):
    """docs: {doc_id: text} -> {doc_id: (bytes, removed, spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i:i + depth]
            if w in seen:
                gone[i:i + depth] = b"\1" * depth
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: words by source -> target by source; excess goes round until nobody is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    while any(target[s] > most * sizes[s] + 1e-9 for s in names):
        over = [s for s in names if target[s] >= most * sizes[s] - 1e-9]
        excess = sum(target[s] - most * sizes[s] for s in over)
        for s in over:
            target[s] = most * sizes[s]
        free = [s for s in names if s not in over]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[f] for f in free)
    return target


def without_windows(rows, window=35):
    """rows: [(doc_id, text)] -> [(doc_id, words, removed, spans, kept)] in the same order"""
    texts = [SPACED.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        edges = [i for i in range(len(w) + 1) if (i > 0 and gone[i - 1]) != (i < len(w) and gone[i])]
        out.append((d, len(w), sum(gone), list(zip(edges[::2], edges[1::2])), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def runs(words, shortest=24, repeats=3):
    """[(start, length, period)] of maximal runs, by trying every period"""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(shortest, repeats * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def hard_negatives(rows, is_anchor, low=50, high=95, scale=256):
    """rows: [(vec_id, components, label)] -> sorted [(anchor, positive, rank, negative, positive's score, negative's score)]"""
    usable = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
              if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, label, v in usable:
        if is_anchor(i):
            others = sorted((-sum(x * y for x, y in zip(v, w)), j, l) for j, l, w in usable if j != i)
            for s, j, _ in [o for o in others if o[2] == label][:5]:
                fits = [o for o in others if o[2] != label and low * -s <= 100 * -o[0] <= high * -s]
                out |= {(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(fits[:3], 1)}
    return sorted(out)
