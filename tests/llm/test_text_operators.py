"""HTML extraction, fingerprints, decontamination, toxicity and language identification."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skytable.llm import decontamination, fingerprints, html_text, language_id, toxicity
from skytable.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, sketch string")


# HTML


def test_main_text_leaves_out_what_is_not_the_article():
    long = "A sentence of the article that is long enough to stand out from all menus. " * 4
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>"
        "<div class='cookie-banner'>We use cookies</div><article><h1>Head&amp;line</h1><p>" + long + "<br>more&nbsp;  text<p>Short.<p>" + long +
        "<form><input><button>Go</button></form><div class=comments><p>" + long + "</div></article><aside><p>" + long + "</aside><footer>&copy; x</footer><script>var a='</p>'</script>"
    )
    body = " ".join(long.split())
    assert html_text.main_text(page) == f"Head&line\n\n{body} more text\n\nShort.\n\n{body}"


def test_main_text_without_article_element():
    long = "Words of a paragraph that go on for quite a while and say something. " * 5
    page = "<body><div><a>a</a><a>b</a><a>c</a></div><div><a>d</a><a>e</a></div>" + f"<div><p>{long}</p><p>Tiny</p><p>{long}</p></div>" + "<div><a>f</a><a>g</a><a>h</a></div>"
    body = long.strip()
    assert html_text.main_text(page) == f"{body}\n\nTiny\n\n{body}"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain  words", "plain words"), ("<p>", ""), ("<nav>only menu</nav>", ""), ("<p>a &lt; b", "a < b"), ("<" * 50, "<" * 50)])
def test_main_text_edges(html, text):
    assert html_text.main_text(html) == text


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>x</article>"), (1, "u", "<article><p>x</article>"), (None, None, None)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract(frame).collect()) == [(0, "", "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]
    assert html_text.extract(frame.limit(0)).count() == 0


# Fingerprints


def shingles(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_fingerprints_against_sets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ORDER_BYTES", 200_000)
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in frame.collect()}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
    error = []
    for k, i in enumerate(ids):
        text, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        m = len(text) // 3
        edited = text[: len(text) - m] + nxt[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(text), shingles(edited), shingles(nxt)
        error += [abs(r.near_edited - len(a & b) / len(a | b)), abs(r.near_next - len(a & c) / len(a | c))]
        assert abs(r.n_shingles - len(a)) <= max(1, 0.4 * len(a))
    assert sum(error) / len(error) < 0.02 and max(error) < 0.25


def test_fingerprint_edges(spark):
    rows = [(1, None), (2, ""), (2, "a b c"), (None, "a b c"), (7, "x" * 9)]
    got = sorted(((r.doc_id or -1, r.n_chars, r.fingerprint) for r in fingerprints.fingerprints(docs(spark, rows)).collect()))
    assert [(i, n) for i, n, _ in got] == [(-1, 3 + 2), (1, 0), (2, 0), (2, 5), (7, 9)]
    assert got[1][2] == got[2][2] == "" and got[0][2] == got[3][2] != ""
    one = fingerprints.fingerprints(docs(spark, [(3, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0


def test_sketches_merge_and_tell_containment(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(2000, 6000))
    frame = spark.createDataFrame([(1, a), (1, b), (2, a)], "k int, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    merged = {r.k: r for r in fingerprints.merge_parts(frame.select("k", "s"), ["k"], "s").withColumn("n", fingerprints.distinct_count(F.col("s"))).collect()}
    assert abs(merged[1]["n"] / 5992 - 1) < 0.35
    part = frame.filter("k = 2").first().s
    whole = merged[1]["s"]
    pair = spark.createDataFrame([(part, whole)], "a array<long>, b array<long>")
    held = pair.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("r")).first()
    assert held.c > 0.6 and abs(held.r - 2996 / 5992) < 0.2


# Decontamination


def test_decontamination_finds_what_a_scan_finds(spark):
    frame, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, questions = frame.select("doc_id", "text").collect(), items.collect()
    want = {(d.doc_id, q.item_id) for d in texts for q in questions if q.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, items).collect()}
    assert want and want <= got and len(got) <= len(want) + 2


def test_block_max_wand_equals_all_scores(spark, monkeypatch):
    import numpy as np

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = " ".join(r.text for r in items.limit(4).collect()) + " the of and it"
    for block in (1, 4, 16):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        index = decontamination.indexes(items)[0]
        query = np.unique([index.number[w] for w in decontamination.terms(text) if w in index.number])
        score = np.zeros(len(index.items))
        for t in query:
            score[index.item[index.ends[t] : index.ends[t + 1]]] += index.impact[index.ends[t] : index.ends[t + 1]]
        for limit in (0.2, 0.5, 0.99):
            want = {i: round(s, 9) for i, s in enumerate(score) if s >= limit}
            passages, blocks = index.candidate_blocks(np.zeros(len(query), np.int64), query, 1, limit)
            got = {i: round(s, 9) for b in blocks.tolist() for i, s in index.wand(query, b, limit)}
            assert got == want and want


def test_decontamination_edges(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 2)
    items = spark.createDataFrame([(1, "Who wrote the long book? Nobody knows it."), (1, "Who wrote the long book? Nobody knows it."), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon"), (5, "one two three four. five six")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "x who WROTE the long book nobody knows it y"), (3, "x who WROTE the long book nobody knows it y"), (4, "who wrote the long book"), (None, "alpha beta gamma delta epsilon")]
    got = sorted((r.doc_id or -1, r.item_id) for r in decontamination.contaminated(docs(spark, rows), items).collect())
    assert got == [(-1, -1), (3, 1), (3, 1)]
    assert decontamination.contaminated(docs(spark, rows), items.limit(0)).count() == 0
    assert decontamination.contaminated(docs(spark, []), items).count() == 0


# Toxicity and language


def test_toxicity_on_held_out_documents(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    usable = crc_mod(F.col("doc_id"), 5) != 0
    scored = toxicity.score(frame, toxicity.train(frame, labels, usable)).join(labels, "doc_id").filter(~usable)
    r = scored.agg(F.count_if(F.expr("toxic = 1 AND predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 0 AND predicted = 1")).alias("fp"), F.count_if(F.expr("toxic = 1")).alias("p"), F.count_if(F.expr("toxic = 0")).alias("n")).first()
    assert r.tp >= 0.85 * r.p and r.fp <= 0.05 * r.n


def test_toxicity_edges(spark):
    rows = [(i, f"nice words here {i}") for i in range(60)] + [(i, f"you awful clownish thing {i}") for i in range(60, 90)] + [(None, None), (200, ""), (200, "")]
    labels = spark.createDataFrame([(i, int(i >= 60), 1) for i in range(90)] + [(None, 1, 1), (300, None, 0), (61, 1, 0)], "doc_id long, toxic int, quality int")
    frame = docs(spark, rows)
    model = toxicity.train(frame, labels, F.lit(True))
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == int(r.doc_id >= 60) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert toxicity.score(frame.limit(0), model).count() == 0
    assert {r.predicted for r in toxicity.score(frame, toxicity.train(frame, labels.limit(0), F.lit(True))).collect()} == {0}


def test_language_on_held_out_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    usable = crc_mod(F.col("doc_id"), 4) != 2
    got = language_id.predict(frame, language_id.train(frame, usable)).join(frame.select("doc_id", "lang"), "doc_id").filter(~usable)
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["share"] > 0.98 and 0 <= r["low"] and r["high"] <= 1


def test_code_lengths_equal_definition(spark):
    import numpy as np

    texts = [("x", "abracadabra"), ("x", "abba"), ("y", "banana band")]
    frame = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.Model(*language_id.train(frame, F.lit(True)))
    count = {}
    for lang, t in texts:
        data = t.encode()
        for i in range(len(data)):
            for o in range(min(i, language_id.ORDER) + 1):
                seen = count.setdefault((lang, data[i - o : i]), {})
                seen[data[i]] = seen.get(data[i], 0) + 1

    def bits(lang, data):
        total = 0.0
        for i in range(len(data)):
            for o in range(min(i, language_id.ORDER), -2, -1):
                if o < 0:
                    total += 8
                    break
                seen = count.get((lang, data[i - o : i]), {})
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total -= np.log2(seen[data[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d))
        return total

    for probe in ("abra", "bandana", "zzz", "a", "", "b\nan"):
        data = probe.encode()
        got = model.lengths(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert np.allclose(got, [bits(lang, data) for lang in model.langs], atol=1e-3)


def test_no_context_of_a_small_language_is_dropped(spark):
    import numpy as np

    # The large language has more contexts of three bytes than were kept before, each more frequent than those of the small one.
    rng = np.random.default_rng(1)
    large = "".join(chr(0x4E00 + x) for x in rng.integers(0, 12_000, 60_000)) * 2
    frame = spark.createDataFrame([(1, large, "zz"), (2, "qvxqvy", "aa")], "doc_id long, text string, lang string")
    model = language_id.Model(*language_id.train(frame, F.lit(True)))
    got = model.lengths(np.frombuffer(b"qvxqvy", np.uint8), np.array([0, 6]))[0, model.langs.index("aa")]
    # q: 2 of 6, 4 kinds. v after q, x after qv, q after qvx, v after vxq, y after xqv.
    want = np.log2(10 / 2) + np.log2(3 / 2) + np.log2(4) + 1 + 1 + 1
    assert abs(got - want) < 1e-3


def test_language_edges(spark):
    frame = spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de"), (3, None, "en"), (4, "12 3", None), (None, "the cat", None), (5, "", "fr")], "doc_id long, text string, lang string")
    model = language_id.train(frame, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()}
    assert got[1][0] == got[None][0] == "en" and got[2][0] == "de"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert language_id.predict(frame.limit(0), model).count() == 0
    none = language_id.train(frame.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(frame, none).collect()} == {"und"}


def test_a_second_model_is_not_scored_with_the_first(spark):
    first = spark.createDataFrame([(1, "aaaa aaaa aaaa", "x"), (2, "bbbb bbbb bbbb", "y")], "doc_id long, text string, lang string").coalesce(1)
    second = first.replace({"x": "y", "y": "x"}, subset=["lang"])
    for _ in range(3):
        for docs in (first, second):
            found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs, F.lit(True))).collect()}
            assert found == {r.doc_id: r.lang for r in docs.collect()}
