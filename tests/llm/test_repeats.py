import random

import brute
import numpy as np
import pytest

from skytable.llm import repeats, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def tricky(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "é", "w x", "the", "zzz", "İ", "q"] + [f"w{i}" for i in range(30)]
    base = [rng.choice(words) for _ in range(160)]
    rows = [(5, None), (6, ""), (7, "one"), (8, "x " * 90), (9, " \t\n ")]
    for i in range(10, 40):
        a = rng.randrange(100)
        b = a + rng.randrange(5, 60)
        body = base[a:b] if rng.random() < 0.7 else [rng.choice(words) for _ in range(60)]
        text = rng.choice([" ", "  ", "\n"]).join(body + [rng.choice(words) for _ in range(rng.randrange(30))])
        rows.append((i, text))
    rows += [(90, rows[12][1]), (91, rows[12][1])]
    return rows


def real(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, key int")


@pytest.mark.parametrize("hot", [2_000, 1])
@pytest.mark.parametrize("length,gram,seed", [(20, 6, 1), (4, 2, 2)])
def test_words_equal_brute_force(spark, monkeypatch, hot, length, gram, seed):
    monkeypatch.setattr(repeats, "HOT_KINDS", hot)
    rows = tricky(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_words(frame(spark, rows), length, gram).collect()}
    assert got == brute.dedup_words(rows, length)
    assert sum(v[1] for v in got.values()) > 50


def test_words_on_documents(spark):
    rows = real(spark)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_words(frame(spark, rows)).collect()}
    assert got == brute.dedup_words(rows)


@pytest.mark.parametrize("hot", [2_000, 1])
@pytest.mark.parametrize("length,gram,seed", [(40, 8, 1), (12, 5, 2)])
def test_bytes_equal_brute_force(spark, monkeypatch, hot, length, gram, seed):
    monkeypatch.setattr(repeats, "HOT_KINDS", hot)
    rows = tricky(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(frame(spark, rows), length, gram).collect()}
    want = brute.dedup_bytes(rows, length)
    assert got == {rows[k][0]: v for k, v in want.items()}


def test_bytes_on_documents(spark):
    rows = real(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect()}
    want = brute.dedup_bytes(rows)
    assert got == {rows[k][0]: v for k, v in want.items()}


def test_repeated_ids_and_null_ids(spark):
    long = " ".join(f"v{i}" for i in range(120))
    rows = [(1, long), (1, long), (1, "other text"), (None, long), (None, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.dedup_words(frame(spark, rows)).collect())
    assert got == [(-1, 0, 0), (-1, 120, 0), (1, 2, 0), (1, 120, 120), (1, 120, 120)]
    got = sorted((r.doc_id or -1, r.n_bytes - r.n_removed) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (1, 10)]


def test_empty_tables(spark):
    assert substring_dedup.dedup_words(frame(spark, [])).count() == 0
    assert suffix_dedup.dedup_bytes(frame(spark, [])).count() == 0


def test_one_long_row_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 300)
    rows = tricky(3) + [(99, " ".join(t or "" for _, t in tricky(3)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_words(frame(spark, rows), 6, 2).collect()}
    assert got == brute.dedup_words(rows, 6)


def test_run_index_statistics():
    rng = np.random.default_rng(5)
    for _ in range(30):
        text = rng.integers(0, 3, rng.integers(2, 80))
        text[-1] = 0
        raw = text.tolist()
        n = len(raw)

        def match(a, b):
            k = 0
            while max(a, b) + k < n and raw[a + k] == raw[b + k]:
                k += 1
            return k

        want = [max([match(p, q) for q in range(n) if q != p], default=0) for p in range(n)]
        assert suffix_dedup.RunIndex(text.astype(np.int64)).statistics().tolist() == want
