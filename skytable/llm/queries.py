"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.fixtures import table
from skytable.llm import (
    collocations,
    conversation_trie,
    decontamination,
    fingerprints,
    html_text,
    language_id,
    license_scan,
    minhash_dedup,
    sentencepiece_codec,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)
from skytable.llm.common import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document covered by a window of 20 words that also starts earlier."""
    return substring_dedup.dedup_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op4_substring_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM texts WHERE len(w) >= 20)
), again AS (
    SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts
), kept AS (
    SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS kept
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by a string of 400 bytes that also starts elsewhere."""
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked when 80 % of their two-word shingles are common, and their components."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_hash")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a fifth of the documents are never learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_mod(F.col("doc_id"), 5)
    scored = toxicity.score(docs, toxicity.train(docs, labels, fold != 0))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the documents is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 4)
    found = language_id.predict(docs, language_id.train(docs, fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document's text, and the digest of what decoding them gives."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = sentencepiece_codec.Vocabulary()
    encoded = sentencepiece_codec.encode(docs, vocabulary)
    decoded = sentencepiece_codec.decode(encoded, vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, with the items."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words that stand together, of each language of the documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, covered=50, top=2000)


ORACLES["op11_phrase_collocations"] = r"""
WITH split AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, pos AS part, piece
    FROM (
        SELECT lang, doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
        FROM (
            SELECT lang, doc_id, regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents)
        )
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM lists, (VALUES (1), (2), (3)) AS sizes(k)
    WHERE len(w) >= k
), f AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidate AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), inner_pairs AS (
    SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, a AS longer FROM candidate, (VALUES (1), (2)) AS starts(s) WHERE k = 3
), dropped AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidate c JOIN inner_pairs i USING (lang, phrase) WHERE c.k = 2 AND 100 * i.longer >= 50 * c.a
), cuts AS (
    SELECT c.lang, c.phrase, c.a, cut, lf.f AS l, rf.f AS r,
        ((1000000::HUGEINT * c.a * c.a) // (lf.f::HUGEINT * rf.f))::BIGINT AS score
    FROM candidate c
    JOIN (VALUES (1), (2)) AS places(cut) ON cut < c.k
    JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(c.w[1:cut], ' ')
    JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
    WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = c.lang AND d.phrase = c.phrase)
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a byte-pair model, and whether they are more than 4,096."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every common beginning of the rebuilt conversations, with what its subtree holds and saves."""
    return conversation_trie.nodes(table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_trie"] = r"""
WITH turns AS (
    SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
    SELECT c, own, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
    FROM turns
), rebuilt AS (
    SELECT t.c, list_concat(coalesce(b.own, [])[1:t.h], t.own[t.h + 1:]) AS path
    FROM heads t LEFT JOIN turns b ON b.c = t.c - t.c % 20
), steps AS (
    SELECT c, len(path) AS size, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
    SELECT depth, path[1:depth] AS prefix, min(c) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256,
        CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS words
    FROM steps GROUP BY depth, prefix, words
), edges AS (
    SELECT n.depth, n.prefix, n.conv_id, p.conv_id AS parent_conv_id, n.n_convs, n.ends_sha256, n.words,
        (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[1:n.depth] = n.prefix) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), sums AS (
    SELECT top, prefix[1:top] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM edges) GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM edges JOIN sums ON sums.top = edges.depth AND sums.prefix = edges.prefix
"""
