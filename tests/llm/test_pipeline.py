import brute

import corpus_pipeline
from skytable.llm import sentencepiece_codec

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string, spans int"


def plain(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_equal_plain_programs(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = stages["toxicity"](spark, docs, SF)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(plain(toxic))
    assert toxic.columns == docs.columns
    assert sum(labels[i] == 0 and i not in kept for i in labels) <= 4
    near = stages["minhash_near_dedup"](spark, docs, SF)
    rows = sorted(plain(docs).items())
    assert set(plain(near)) == {i for i, v in brute.near_duplicates(rows, 5).items() if v[2]}
    cut = stages["suffix_array_dedup"](spark, near, SF)
    assert cut.columns == docs.columns
    sizes = {r.doc_id: (len(r.text.encode()), r.n_chars == len(r.text)) for r in cut.collect()}
    near_rows = sorted(plain(near).items())
    for k, (n, gone, _, _) in brute.dedup_bytes(near_rows).items():
        size, counted = sizes[near_rows[k][0]]
        assert counted and n - gone - 6 * 4 <= size <= n - gone
    clean = stages["benchmark_decontamination"](spark, docs, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in rows if any(x in t for x in items)}
    assert leaked and leaked.isdisjoint(plain(clean)) and len(rows) - len(leaked) - clean.count() <= 1
    last = stages["sentencepiece"](spark, clean, SF)
    assert plain(last) == plain(clean)


def test_run_keeps_only_what_all_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert 100 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
    assert all(len(r.ids) == r.n_pieces for r in rows)


def test_stages_take_odd_rows(spark):
    text = "the same words again and again in this long text of one document " * 12
    rows = [(1, text, None, None, None, "e", 1), (1, text, None, None, None, "e", 1), (1, "other words", "en", "s", 5, None, None), (None, None, None, None, None, None, None), (None, "x", None, None, None, None, 1), (2, "", None, None, 0, None, 1)]
    for data, sizes in ((rows, [6, 5, 5, 5, 5]), ([], [0] * 5)):
        docs = spark.createDataFrame(data, COLUMNS)
        for (name, stage), n in zip(corpus_pipeline.STAGES, sizes):
            docs = stage(spark, docs, SF)
            assert docs.count() == n, name
