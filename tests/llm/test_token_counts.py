"""Token counts against the library that made the model file."""

import random

import public_tokenizers
import pytest
import sentencepiece

from skytable.llm.token_counts import Merges, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def hard_texts(n=400):
    rng = random.Random(5)
    letters = "abcdeghijlnorstuyABST  ,.\n\t'\"-_/<>1230▁éüßñçñ漢字かな　\xa0\U0001f600\U0001f468‍́ﬁ"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library(codec):
    merges = Merges(PATH)
    for text in hard_texts() + ["aaaaaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x" + " " * 17, "<s>", "</s><unk><0x41>", "\r\n\r\n", "\x00\x01"]:
        assert merges.tokens(text) == len(codec.encode(text)), text


def test_rows(spark, codec):
    texts = [*hard_texts(60), None, "", " ", "the the the", "x" * 30_000, "word " * 5_000, "漢" * 2_000]
    rows = [(i, t, "other") for i, t in enumerate(texts)] + [(None, "a null id", None), (3, texts[3], "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in count_tokens(docs, PATH, 100).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        n = len(codec.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)
    assert count_tokens(docs.limit(0), PATH).collect() == []


def test_a_small_table_of_spans_changes_nothing(spark, codec, monkeypatch):
    monkeypatch.setattr("skytable.llm.token_counts.KEPT_BYTES", 300)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(hard_texts(80))], "doc_id long, text string").coalesce(1)
    assert all(r.n_tokens == len(codec.encode(docs_text)) for r, docs_text in zip(count_tokens(docs, PATH).orderBy("doc_id").collect(), hard_texts(80)))


def test_registered_query(spark, codec):
    from skytable.fixtures import table
    from skytable.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    want = {r.doc_id: len(codec.encode(r.text)) for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op13_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
