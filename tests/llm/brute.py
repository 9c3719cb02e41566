"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def dedup_words(docs, length=20):
    """docs: (doc_id, text) with different ids -> {doc_id: (n_words, n_removed, sha256)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for j in range(len(words) - length + 1):
            window = tuple(words[j : j + length])
            if window in seen:
                gone[j : j + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def dedup_bytes(docs, length=400):
    """rows (doc_id, text) -> {row number: (n_bytes, n_removed, n_spans, sha256)}"""
    count = {}
    data = [(text or "").encode() for _, text in docs]
    for d in data:
        for j in range(len(d) - length + 1):
            w = hash(d[j : j + length])
            count[w] = count.get(w, 0) + 1
    out = {}
    for row, d in enumerate(data):
        gone = bytearray(len(d))
        for j in range(len(d) - length + 1):
            if count[hash(d[j : j + length])] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[row] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    words = WORDS.findall(lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_duplicates(docs, width, percent=80):
    """docs: (doc_id, text) with different ids -> {doc_id: (n_shingles, component_id, kept)}"""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    ids = sorted(sets)
    for a in ids:
        near = {}
        for x in sets[a]:
            for b in where[x]:
                if b > a:
                    near[b] = near.get(b, 0) + 1
        for b, common in near.items():
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
