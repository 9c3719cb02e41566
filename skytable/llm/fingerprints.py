"""Document fingerprints: bottom-k sketches of shingle hashes, from DataFrame functions only.

A sketch is the sorted list of the ``K`` least distinct hashes of a document's shingles. Sketches of
parts merge to the sketch of the whole. The least hashes of a union are a sample of it, so the
share that both sketches hold estimates resemblance and containment, and the K-th least hash tells
how many distinct shingles there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 128
SHINGLE_WORDS = 5
_RANGE = float(1 << 64)
# Text that one task should hold when documents are put in order of id.
ORDER_BYTES = 8 << 20
_SPACES = r"[\x20\x09-\x0D]+"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sketch(text: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    """The ``k`` least distinct hashes of the shingles of ``width`` words, ascending.

    A text with fewer words is one shingle; null, empty or blank text has an empty sketch.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        parts = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(parts)), 1, k))

    return _bind(hashes, shingles)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    reach = (F.element_at(s, -1).cast("double") + F.lit(_RANGE / 2)) / F.lit(_RANGE)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def _common(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    whole = merge(a, b, k)
    return F.size(F.array_intersect(whole, F.array_intersect(a, b))), F.size(whole)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated common share of both sets, 0 to 1; two empty sets are alike."""
    common, size = _common(a, b, k)
    return F.when(size == 0, F.lit(1.0)).otherwise(common / size)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second holds, 0 to 1; nothing is held whole."""
    common, size = _common(a, b, k)
    united = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / size * united / distinct_count(a, k)))


def as_text(s: Column) -> Column:
    """A sketch as one string of hexadecimal numbers."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_parts(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts; equal hashes of a key are combined before they travel."""
    least = F.explode(column).alias("h")
    rows = parts.select(*keys, least).distinct()
    return rows.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def with_next(docs: DataFrame, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text, sketch, nxt, nxt_sketch): the last two are those of the next document in descending order of doc_id.

    The order is cyclic. Documents are put in ranges of ids between quantiles, a range is ordered in one
    task, and the first document of each range goes to the end of the range before it. Null ids come
    last, equal ids stand in order of their text's hash, and a single document is its own next one.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.length("text").cast("long")).alias("chars"), F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    ranges = max(1, -(-(size["chars"] or 0) // ORDER_BYTES))
    cuts: list[int] = []
    if ranges > 1 and size["top"] is not None:
        shares = [i / ranges for i in range(1, ranges)]
        found = plain.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0]  # one number for each range
        cuts = sorted(set(found) - {size["top"]})
    # Each cut is an id that is there, so no range is empty. Ids run down: range 0 has the greatest.
    last = len(cuts) + (1 if size["nulls"] and size["top"] is not None else 0)
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), last).otherwise(above).cast("int")
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    ordered = (
        plain.withColumn("part", part).repartition("part").withColumn("sketch", sketch(F.col("text"), k, width))
        .withColumn("nxt", F.lead("text").over(inside)).withColumn("nxt_sketch", F.lead("sketch").over(inside))
        .withColumn("turn", F.row_number().over(inside))
    )
    heads = ordered.filter("turn = 1").select(
        F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1).cast("int").alias("part"), F.col("text").alias("head"), F.col("sketch").alias("head_sketch")
    )
    joined = ordered.join(heads, "part")
    ends = F.col("nxt").isNull()
    return joined.select(
        "doc_id", "text", "sketch", F.when(ends, F.col("head")).otherwise(F.col("nxt")).alias("nxt"),
        F.when(ends, F.col("head_sketch")).otherwise(F.col("nxt_sketch")).alias("nxt_sketch"),
    )


def fingerprints(docs: DataFrame, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text; other columns are not used) and of its edited text.

    The edited text has its last floor(n_chars / 3) characters replaced by the first ones of the next
    document (``with_next``), as many or all there are. Null text counts as empty. Gives doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the estimated number of
    distinct shingles. Empty texts have an empty fingerprint and are alike. Repeated rows stay, each with its own
    next row, and an empty table gives no rows.
    """
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    rows = with_next(docs, k, width).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - moved), F.substring("nxt", F.lit(1), moved)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k, width))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("nxt_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )
