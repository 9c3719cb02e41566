import random

import pytest
import sentencepiece

from skytable.llm import sentencepiece_codec as codec

RAW = open(codec.DEFAULT_MODEL, "rb").read()
UNIGRAM = RAW.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01")
TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "hello  world\n\nfoo", "x" * 60 + " " + "ab" * 200, "日本語 𓀀\x00\r\n\tq", "ﬁ Ａ é", "    deep\n        indent",
    "the the the", "A" + " " * 40 + "B", "naïve café — déjà vu", "\n \n", "0123456789 " * 3, "q" * 500,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")


def check(spark, texts, raw):
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    vocabulary = codec.Vocabulary(model=raw)
    found = codec.encode(frame(spark, texts), vocabulary)
    got = {r.doc_id: r.ids for r in found.collect()}
    want = {i: library.encode(t or "") for i, t in enumerate(texts)}
    if vocabulary.kind == "unigram":
        # The library keeps one path; ours has its score or a better one, and nearly always its pieces.
        worth = lambda ids: sum(library.get_score(i) for i in ids)
        assert all(worth(got[i]) >= worth(want[i]) for i in want)
        assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    else:
        assert got == want
    back = {r.doc_id: r.text for r in codec.decode(found, vocabulary).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("words", [codec.DICTIONARY_WORDS, 3])
@pytest.mark.parametrize("raw", [RAW, UNIGRAM], ids=["bpe", "unigram"])
def test_equals_library_on_hard_texts(spark, monkeypatch, raw, words):
    monkeypatch.setattr(codec, "DICTIONARY_WORDS", words)
    rng = random.Random(3)
    noise = ["".join(rng.choice("etaoin shrdlu\nüß ") for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    check(spark, TEXTS + noise + TEXTS, raw)


def test_equals_library_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    check(spark, [r[0] for r in rows], RAW)


def test_kinds_and_empty_table(spark):
    assert codec.Vocabulary(model=RAW).kind == "bpe" and codec.Vocabulary(model=UNIGRAM).kind == "unigram"
    vocabulary = codec.Vocabulary()
    found = codec.encode(frame(spark, []), vocabulary)
    assert found.count() == 0 and codec.decode(found, vocabulary).count() == 0


def test_texts_are_scanned_once_for_words(spark, monkeypatch):
    """Short and long words come from one scan; each of them used to scan all texts."""
    plans, write = [], codec.materialize
    monkeypatch.setattr(codec, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    words = codec.encoded_words(frame(spark, ["a bc", "x" * 60, "a"]), codec.Vocabulary()).collect()
    assert len(words) == 3 and all(r.ids for r in words)
    assert plans[0].count("MapInArrow scan(") == 1


def test_merges_that_let_an_earlier_one_follow(spark):
    """Words of pieces after which a piece of better score can be merged."""
    vocabulary = codec.Vocabulary()
    ranks = {p: -s for p, _, s in vocabulary.rows if len(p) > 1}
    late = sorted(p for p in codec._completes(ranks) if p.isascii() and p.isalpha())
    rng = random.Random(5)
    check(spark, [" ".join("".join(rng.choice(late) for _ in range(rng.randrange(1, 5))) for _ in range(20)) for _ in range(60)], RAW)


def test_partitions_of_words():
    """A small text is not one partition with all its edges, and none has the words of more than PARTITION_CHARS."""
    assert codec._partitions(0) == 1 and codec._partitions(1_900_000) == 8
    assert all(n / codec._partitions(n) <= codec.PARTITION_CHARS for n in (10**7, 10**9, 3 * 10**10))
