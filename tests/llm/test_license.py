from skytable.llm import license_scan


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {(r.doc_id, r.line): (r.license, round(r.dice, 9)) for r in license_scan.scan(docs).collect() if r.lines == 1}
    want = {}
    templates = [(name, license_scan.bigrams(t.encode())) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    for r in docs.select("doc_id", "text").collect():
        for k, line in enumerate(r.text.split("\n")):
            if "icens" not in line:
                continue
            own = license_scan.bigrams(line.encode())
            value, name = min((-license_scan.dice(own, b), name) for name, b in templates)
            if -value >= license_scan.THRESHOLD:
                want[r.doc_id, k] = (name, round(-value, 9))
    assert got == want and len(want) > 200
    assert {v[0] for v in want.values()} == {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"}


def test_wrapped_notice_and_edits(spark):
    words = license_scan.TEMPLATES["MIT"][2].split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    text = f"Copyright 2020 someone\n\n{wrapped}\n\nint main() {{}}\nlicensed UNDER the apache license version 2.0\n"
    got = [(r.line, r.lines, r.license, r.dice) for r in license_scan.scan(frame(spark, [(1, text)])).collect()]
    assert [g[:3] for g in got] == [(2, len(wrapped.split("\n")), "MIT"), (4 + len(wrapped.split("\n")), 1, "Apache-2.0")]
    assert min(g[3] for g in got) == 1.0


def test_edges(spark):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (None, line), (5, "word"), (6, line + " " + "z " * 50_000)]
    got = sorted((r.doc_id or -1, r.line, r.license) for r in license_scan.scan(frame(spark, rows)).collect())
    assert got == [(-1, 0, "MIT"), (4, 0, "MIT"), (4, 0, "MIT")]
    assert license_scan.scan(frame(spark, [])).count() == 0
    assert license_scan.scan(frame(spark, rows), {}).count() == 0


def test_paragraphs_and_neighbouring_notices(spark):
    mit, apache = license_scan.TEMPLATES["MIT"][2], license_scan.TEMPLATES["Apache-2.0"][1]
    cut = [mit.index("The above copyright"), mit.index("THE SOFTWARE IS")]
    paragraphs = "\n\n".join([mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]])
    words = apache.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    n = len(wrapped.split("\n"))
    rows = [(1, paragraphs), (2, f"{wrapped}\nReleased under the MIT License.\n{mit}"), (3, f"Released under the MIT License.\n{wrapped}")]
    got = sorted((r.doc_id, r.line, r.lines, r.license, r.dice) for r in license_scan.scan(frame(spark, rows)).collect())
    assert [g[:4] for g in got] == [(1, 0, 5, "MIT"), (2, 0, n, "Apache-2.0"), (2, n, 1, "MIT"), (2, n + 1, 1, "MIT"), (3, 0, 1, "MIT"), (3, 1, n, "Apache-2.0")]
    assert min(g[4] for g in got) == 1.0
