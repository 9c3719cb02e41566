"""Collocations against a plain program, in words of any kind and with counts past 64 bits."""

import re
from collections import Counter

import pytest

from skytable.llm import collocations as c
from skytable.llm.collocations import collocations


def brute(rows, least, covered, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= covered * a for q, b in many.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


ROWS = [
    ("en", "New York is BIG, new york is old. New  York\tis new"),
    ("en", "new york, is new york is new"),
    (None, "a a a a a; a a\ra b a b\n\na b A B"),
    ("und", "É é é É é.é é"),
    ("de", None),
    ("de", ""),
    ("de", " .,;:!? \x0b\x0c"),
    ("de", "\x00 \x00 \x00 x\x00y x\x00y \x85 \xa0 \x85 \xa0"),
    (None, "a a a a a; a a\ra b a b\n\na b A B"),
    ("fr", "mot " * 3000),
]


@pytest.mark.parametrize("least,covered,top", [(2, 50, 100), (1, 100, 5), (3, 1, 2000)])
def test_equals_plain_counts(spark, monkeypatch, least, covered, top):
    monkeypatch.setattr(c, "CHUNK_BYTES", 40)
    monkeypatch.setattr(c, "BUCKET_BYTES", 2000)
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in ROWS], "lang string, text string, a int, phrase string")
    assert sorted(tuple(r) for r in collocations(docs, least, covered, top).collect()) == brute(ROWS, least, covered, top)


def test_a_full_filter_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "FILTER_BITS", 3)
    monkeypatch.setattr(c, "_BLOCK_BITS", 3)
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(docs, 2, 50, 100).collect()) == brute(ROWS, 2, 50, 100)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string, doc_id long")
    assert collocations(docs).collect() == []


def test_products_past_64_bits(spark):
    row = spark.createDataFrame([(4_000_000_000_000, 4_000_000_000_007, 4_000_000_000_011)], "a long, l long, r long")
    assert row.select(c._score("a", "l", "r")).first()[0] == 1000000 * 4_000_000_000_000**2 // (4_000_000_000_007 * 4_000_000_000_011)
