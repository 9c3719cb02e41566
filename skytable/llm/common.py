"""Helpers shared by the training-data operators: tables, document keys, joins with a checked broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.operators.skew import numbered
from skytable.session import materialize, spent_shuffles

# A join side is broadcast only when it has been counted and is no larger than this;
# beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# Marks of ``marked`` in all, and those in one row of its table (what Spark's bitmaps hold).
MARK_BITS = 1 << 27
MARK_PAGE = 1 << 15


# Rows and bytes that one Arrow batch may hold, so that long texts meet Python in small batches.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def text_hash(text: str = "text") -> Column:
    """Hash by which rows of one id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(key, doc_id, text) of ``docs``: ``key`` is a non-null long that orders documents by doc_id.

    With unique ids the key is the id. If an id is null or repeated, the distinct
    (doc_id, text) pairs are numbered in order of id (null first) and text hash, so rows
    that repeat a document share its key and different texts under one id do not. With ``whole``
    all columns of a row follow as the struct ``row``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    plain = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    names = ["doc_id", "text", *(["row"] if whole else [])]
    ids = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 OR doc_id IS NULL").isEmpty():
        return plain.select(F.col("doc_id").alias("key"), *names)
    hashed = plain.withColumn("h", text_hash()).withColumn(
        "o", F.coalesce("doc_id", F.lit(-(2**63)))
    )
    order = materialize(numbered(hashed.select("o", "h").distinct(), [], ["o", "h"], "key"))
    return hashed.join(order, ["o", "h"]).select("key", *names)


def small_side(df: DataFrame, row_bytes: Column | int = 16, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and bytes are within the bounds, else as it is."""
    with spent_shuffles(df.sparkSession):
        size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("b")).first()
    fits = size["n"] <= most and (size["b"] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``keys``; every row whose key is there stays.

    The driver gets a table of marks by key hash, 16 bits for each key and ``MARK_BITS`` at most, in place of the keys.
    For callers that join on the key later anyway: wide rows that nothing asks for are dropped without a shuffle.
    """
    with spent_shuffles(keys.sparkSession):
        wanted = 16 * keys.count()
    bits = max(MARK_PAGE, min(MARK_BITS, 1 << max(wanted - 1, 0).bit_length()))
    slot = F.pmod(F.xxhash64("key"), F.lit(bits).cast("long"))
    page, place = F.floor(slot / MARK_PAGE), slot % MARK_PAGE
    pages = keys.select(page.alias("_page"), place.alias("_place")).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    cell = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mark = F.floor(cell / F.pow(F.lit(2), place % 8)) % 2
    return rows.join(F.broadcast(pages), (page == F.col("_page")) & (mark == 1), "left_semi")


def fill(df: DataFrame, names: Sequence[str], value) -> DataFrame:
    """Replace nulls of an outer join."""
    return df.fillna(value, subset=list(names))
