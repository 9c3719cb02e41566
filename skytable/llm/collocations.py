"""Phrases of two and three words that stand together more often than their parts suggest.

Stripes: every prefix keys an associative counter of the words that follow it, and the counter also holds the
prefix's own total under a symbol that no word can be. A task counts the stripes of a few megabytes of text at a
time, cuts them into buckets by the hash of prefix and next word and hands on one row for each bucket, so neither
a frequent word nor a frequent pair is one key. The rows of a bucket are merged element by element. From the
merged stripes come the extensions (entries), the prefix totals and the greatest longer phrase around each pair.

Two rounds: prefixes of one word, then prefixes of two words, where only those places are counted whose both pairs
may have reached ``least``. The test is a table of bits of fixed size set at the hashes of such pairs: a clash lets a
place through to be counted, it never drops one.

Nulls: a null text is empty, a null lang counts as ``und``. Ids play no part, so repeated rows count as often as
they stand, and an empty table gives no rows. Only ``text`` and ``lang`` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm import units
from skytable.llm.common import bounded_batches, small_side
from skytable.operators.skew import numbered
from skytable.session import materialize

# Text that a task counts at a time, and text for each bucket of merged stripes.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20
# Bits of the table that says which pairs may be frequent, as a power of two, and bits of one block of it.
FILTER_BITS = 27
_BLOCK_BITS = 20
# Between words of a stripe, before its prefix, and in place of the next word where its own total stands.
_BLANK, _LINE, _TOTAL = b" ", b"\n", b"\r"

_WORD, _GAP, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_STRIPE_KIND = np.zeros(256, np.uint8)
_STRIPE_KIND[[*_BLANK]] = _GAP
_STRIPE_KIND[[*_LINE]] = _END
_FIRST, _SECOND, _THIRD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

_ROWS = "lang string, bucket int, grams binary, counts binary"
_PAIRS = "lang string, w1 string, w2 string, f long, slot int"
_TRIPLES = "lang string, w1 string, w2 string, w3 string, f long"


def _split(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word in the list of distinct words, that list, piece that each word is in)."""
    classes = kind[data]
    inside = classes == _WORD
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(classes == _END), starts)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, piece


def _hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return units.span_hashes(units.BYTE_VALUES[data], offsets[:-1], offsets[1:])


def _name_hash(lang: str) -> np.uint64:
    return _hashes(pa.array([lang.encode()], pa.large_binary()))[0]


def _mixed(lang: str, *parts: np.ndarray) -> np.ndarray:
    total = np.full(len(parts[0]), _name_hash(lang), np.uint64)
    for factor, part in zip((_FIRST, _SECOND, _THIRD), parts):
        total = units.mix(total + part * factor)
    return total


def _slots(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (_mixed(lang, first, second) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _packed(lang: str, bucket: np.ndarray, prefix: list[np.ndarray], follow: np.ndarray, n: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """One row for each bucket: its stripes as lines ``prefix next next ...`` and the counts of the next words.

    Entries come in order of prefix; ``words`` are those that the numbers stand for.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, follow, n = bucket[order], follow[order], n[order]
    prefix = [p[order] for p in prefix]
    new_row = np.ones(len(bucket), bool)
    new_row[1:] = bucket[1:] != bucket[:-1]
    head = new_row.copy()
    for p in prefix:
        head[1:] |= p[1:] != p[:-1]
    # Each word stands in the list with a line end before it, and again with a blank before it.
    tokens = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(sign, pa.large_binary()), words, pa.scalar(b"", pa.large_binary())) for sign in (_LINE, _BLANK)])
    place = np.arange(len(follow)) + len(prefix) * np.cumsum(head)
    line = np.empty(len(follow) + len(prefix) * int(head.sum()), np.int64)
    line[place] = len(words) + follow
    for k, p in enumerate(prefix):
        line[place[head] - len(prefix) + k] = p[head] + (len(words) if k else 0)
    text = tokens.take(pa.array(line))
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
    rows = np.flatnonzero(new_row)
    cuts = np.append(offsets[place[rows] - len(prefix)], offsets[-1])
    lists = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts), text.buffers()[2]])
    counts = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.append(rows, len(n)).astype(np.int64) * 8), pa.py_buffer(n.astype(np.int64))])
    columns = [pa.array([lang] * len(rows), pa.string()), pa.array(bucket[rows], pa.int32()), lists.cast(pa.binary()), counts.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "grams", "counts"])


def _chunks(batches) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, lower-cased bytes) of texts of about ``CHUNK_BYTES``; texts are kept apart by a line end."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush():
        for lang, texts in held.items():
            yield lang, units.LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from flush()
                    size = 0
    yield from flush()


def _next_words(buckets: int):
    """Stripes of one word: what follows it in its piece, and how often it stands."""

    def count(batches):
        for lang, data in _chunks(batches):
            ids, words, piece = _split(data, _KIND)
            if not len(ids):
                continue
            size = len(words) + 1
            beside = piece[1:] == piece[:-1]
            pairs, n = np.unique(ids[:-1][beside] * size + ids[1:][beside], return_counts=True)
            totals = np.arange(len(words)) * size + len(words)
            codes = np.concatenate([pairs, totals])
            n = np.concatenate([n, np.bincount(ids, minlength=len(words))])
            order = np.argsort(codes, kind="stable")
            first, follow, n = codes[order] // size, codes[order] % size, n[order]
            words = pa.concat_arrays([words, pa.array([_TOTAL], pa.large_binary())])
            hashes = _hashes(words)
            bucket = (_mixed(lang, hashes[first], hashes[follow]) % np.uint64(buckets)).astype(np.int64)
            yield _packed(lang, bucket, [first], follow, n, words)

    return count


def _next_of_pairs(buckets: int, bits):
    """Stripes of two words, at places whose pairs may both be frequent."""

    def count(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for lang, data in _chunks(batches):
            ids, words, piece = _split(data, _KIND)
            if len(ids) < 3:
                continue
            hashes = _hashes(words)
            slot = _slots(lang, hashes[ids[:-1]], hashes[ids[1:]])
            may = (piece[1:] == piece[:-1]) & ((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
            at = np.flatnonzero(may[:-1] & may[1:])
            if not len(at):
                continue
            pairs, pair = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True)
            codes, n = np.unique(pair * len(words) + ids[at + 2], return_counts=True)
            pair, third = codes // len(words), codes % len(words)
            first, second = pairs[pair] // len(words), pairs[pair] % len(words)
            bucket = (_mixed(lang, hashes[first], hashes[second], hashes[third]) % np.uint64(buckets)).astype(np.int64)
            yield _packed(lang, bucket, [first, second], third, n, words)

    return count


def _merged(rows: list[dict], k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array]:
    """(prefix words, next word, count, words): the stripes of a bucket added up, element by element."""
    ids, words, line = _split(np.frombuffer(b"".join(r["grams"] for r in rows), np.uint8), _STRIPE_KIND)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    entry = np.ones(len(ids), bool)
    for j in range(k):
        entry[heads + j] = False
    # Lines count from 1, for each begins with its line end.
    key = ids[heads]
    for j in range(1, k):
        key = key * len(words) + ids[heads + j]
    keys, key = np.unique(key, return_inverse=True)
    codes = key[line[entry] - 1] * len(words) + ids[entry]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    codes, n = codes[order][starts], np.add.reduceat(counts[order], starts)
    prefix, rest = [], keys[codes // len(words)]
    for _ in range(k):
        prefix.append(rest % len(words))
        rest = rest // len(words)
    return prefix[::-1], codes % len(words), n, words


def _by_bucket(batches) -> Iterator[list[dict]]:
    """Rows of one lang and bucket, from rows in that order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["bucket"], held[0]["lang"]) != (row["bucket"], row["lang"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _text(words: pa.Array, ids: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return words.take(pa.array(ids, mask=null)).cast(pa.large_string()).cast(pa.string())


def _frequent_pairs(least: int):
    """Entries and totals of ``least`` and more; the total of a word has no second word, that of all words none at all."""

    def merge(batches):
        for rows in _by_bucket(batches):
            lang = rows[0]["lang"]
            (first,), follow, n, words = _merged(rows, 1)
            total = np.asarray(pc.equal(words, pa.scalar(_TOTAL, pa.large_binary())))[follow]
            hashes = _hashes(words)
            often = n >= least
            slot = _slots(lang, hashes[first[often]], hashes[follow[often]])
            found = [pa.array([lang] * int(often.sum()), pa.string()), _text(words, first[often]), _text(words, follow[often], total[often]), pa.array(n[often]), pa.array(slot, pa.int32())]
            whole = [pa.array([lang]), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([int(n[total].sum())], pa.int64()), pa.array([0], pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(found, whole)], names=["lang", "w1", "w2", "f", "slot"])

    return merge


def _frequent_triples(least: int):
    def merge(batches):
        for rows in _by_bucket(batches):
            (first, second), third, n, words = _merged(rows, 2)
            often = n >= least
            columns = [pa.array([rows[0]["lang"]] * int(often.sum()), pa.string()), *[_text(words, x[often]) for x in (first, second, third)], pa.array(n[often])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "w2", "w3", "f"])

    return merge


def _filter_bits(pairs: DataFrame) -> bytes:
    """The table of bits set at the slots of ``pairs``: 2**FILTER_BITS bits at any input size."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _BLOCK_BITS, np.uint8)
        bits[frame["slot"].to_numpy() & ((1 << _BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = pairs.select("slot").distinct().withColumn("block", F.shiftright("slot", _BLOCK_BITS))
    out = np.zeros((1 << FILTER_BITS - _BLOCK_BITS, 1 << _BLOCK_BITS - 3), np.uint8)
    for row in slots.groupBy("block").applyInPandas(block, "block int, bits binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def stripes(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, w1, w2, f), (lang, w1, w2, w3, f)): what occurs at least ``least`` times.

    In the first, a row without w2 is the total of a word, a row without words the total of all words.
    """
    texts = bounded_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    if buckets > 2**31 - 1:
        raise ValueError("more text than 2**31 buckets hold")

    def settle(count, merge, schema: str) -> DataFrame:
        rows = texts.mapInArrow(count, _ROWS).repartition("bucket").sortWithinPartitions("bucket", "lang")
        return materialize(rows.mapInArrow(merge, schema))

    pairs = settle(_next_words(buckets), _frequent_pairs(least), _PAIRS)
    totals = pairs.filter("w1 IS NULL").groupBy("lang").agg(F.sum("f").alias("f"))
    common = pairs.filter("w1 IS NOT NULL")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(common.filter("w2 IS NOT NULL")))
    triples = settle(_next_of_pairs(buckets, bits), _frequent_triples(least), _TRIPLES)
    none = F.lit(None).cast("string")
    words = common.select("lang", "w1", "w2", "f").union(totals.select("lang", none, none, "f"))
    return words, triples


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = [f"CAST({c} AS DECIMAL(15,0))" for c in (a, left, right)]
    return F.expr(f"({wide[0]} * {wide[0]} * 1000000BD) DIV ({wide[1]} * {wide[2]})")


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two and three words of each lang.

    ``a`` is how often the phrase stands in pieces of its lang, at least ``least`` times, ``l`` and ``r`` how often the two
    parts do at its weakest cut, ``n`` the words of the lang. A phrase is left out where a longer one with
    ``least`` occurrences holds it and has at least ``covered`` percent of them. Equal scores go by ``a``, then by the phrase's bytes.
    """
    found, triples = stripes(docs, least)
    words = found.filter("w1 IS NOT NULL AND w2 IS NULL")
    pairs = found.filter("w2 IS NOT NULL").withColumnRenamed("f", "a")
    one, two = (small_side(words.select("lang", F.col("w1").alias(w), F.col("f").alias(f)), 64) for w, f in (("w1", "f1"), ("w2", "f2")))
    around = (
        triples.select("lang", "w1", "w2", "f")
        .union(triples.select("lang", "w2", "w3", "f"))
        .groupBy("lang", "w1", "w2")
        .agg(F.max("f").alias("longer"))
    )
    of_two = (
        pairs.join(around, ["lang", "w1", "w2"], "left")
        .filter(f"longer IS NULL OR 100 * longer < {int(covered)} * a")
        .join(one, ["lang", "w1"])
        .join(two, ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", _score("a", "l", "r"))
    )
    front = pairs.withColumnRenamed("a", "f12")
    back = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    cuts = (
        triples.withColumnRenamed("f", "a")
        .join(front, ["lang", "w1", "w2"])
        .join(back, ["lang", "w2", "w3"])
        .join(one, ["lang", "w1"])
        .join(two.withColumnsRenamed({"w2": "w3", "f2": "f3"}), ["lang", "w3"])
        .withColumn("early", _score("a", "f1", "f23"))
        .withColumn("late", _score("a", "f12", "f3"))
    )
    first = F.col("early") <= F.col("late")
    of_three = cuts.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("early", "late").alias("score"),
    )
    ranked = numbered(
        of_two.union(of_three).withColumn("_down", -F.col("score")).withColumn("_fewer", -F.col("a")), ["lang"], ["_down", "_fewer", "phrase"], "rank"
    ).filter(F.col("rank") <= top)
    sizes = F.broadcast(found.filter("w1 IS NULL").select("lang", F.col("f").alias("n")))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
