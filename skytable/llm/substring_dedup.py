"""Repeated-phrase automata: remove each run of words that already stands earlier in the corpus.

Anchors (see ``repeats``) find the passages that may recur. Confirmed windows of the passages
are compiled to Aho-Corasick automata over word numbers, one for each stretch of anchors
(a shard of bounded size), and the segments of all documents that hold one of its anchors are
streamed through it; each match gives the first place of its window.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm import repeats, units
from skytable.llm.common import keyed

WINDOW_WORDS = 20
GRAM_WORDS = 6
SHARD_BYTES = 1 << 20
_RANGE = "key long, lo long, hi long"


def _settle(length: int):
    def settle(anchor, n, copies, key, start, parts):
        numbers: dict[bytes, int] = {}
        rows = [tuple(numbers.setdefault(w, len(numbers)) for w in part.split(b" ")) for part in parts]
        flat = units.mix(np.concatenate([np.array(r, np.uint64) for r in rows]) + np.uint64(1))
        first = np.cumsum([0, *map(len, rows)])
        hashes = units.gram_hashes(flat, length)
        at = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in range(len(rows))])
        values, inverse, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
        often = (count > 1)[inverse]
        shard = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        where = np.cumsum([0, *n])
        # Ids rise within an anchor, so the first entry of a window is its first place.
        order = sorted(range(len(rows)), key=lambda i: (key[i], start[i]))
        for i in order:
            for j in np.flatnonzero(often[where[i] : where[i + 1]]).tolist():
                window = rows[i][j : j + length]
                if window not in shard:
                    shard.add_word(window, (key[i], start[i] + j))
        if not len(shard):
            return
        shard.make_automaton()
        out: list[tuple[int, int, int]] = []
        for i in order:
            if not often[where[i] : where[i + 1]].any():
                continue
            for end, place in shard.iter(rows[i]):
                lo = start[i] + end - (length - 1)
                if place != (key[i], lo):
                    if out and out[-1][0] == key[i] and out[-1][1] <= lo <= out[-1][2]:
                        out[-1] = (key[i], out[-1][1], lo + length)
                    else:
                        out.append((key[i], lo, lo + length))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "lo", "hi"])

    return settle


def repeated_words(docs: DataFrame, length: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Word ranges to remove: (key, spans) for ``keyed`` documents that have any."""
    windows = repeats.Windows(length, gram, words=True)
    found = repeats.recurring(docs, windows)
    kind = repeats.kinds(found)
    # Every copy of a segment but the first is covered by windows of the first.
    later = (
        found.join(kind.filter("copies > 1").drop("copies"), ["anchor", "seg", "n"])
        .filter("key != first.key OR start != first.start")
        .select("key", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (length - 1)).alias("hi"))
    )
    few, many = repeats.mixed(kind)
    ranges = later.unionByName(repeats.by_anchor(repeats.segments(docs, few, windows), _settle(length), _RANGE, SHARD_BYTES))
    if not many.isEmpty():
        rows = repeats.window_rows(repeats.segments(docs, many, windows), windows)
        firsts = rows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start")).alias("first")).filter("c > 1")
        ranges = ranges.unionByName(
            rows.join(firsts, ["anchor", "hash"])
            .filter("key != first.key OR start != first.start")
            .select("key", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
        )
    return repeats.per_document(ranges)


def dedup_words(docs: DataFrame, length: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Each document without its repeated words: (doc_id, n_words, n_removed, kept_sha256, kept, spans).

    ``docs`` has doc_id and text; other columns are not used. Words are runs of characters
    other than space and 9 to 13, taken unchanged from the whole text. ``spans`` are the
    removed ranges of word numbers, ``kept`` the other words joined by one space.

    Null or empty text: no words, nothing removed, ``kept`` empty. Fewer than ``length`` words:
    nothing removed. Rows that share an id but not a text are different documents, in the
    order of a hash of their texts; equal rows stand for one document and get one result.
    A null id comes before all others. An empty table gives no rows.
    """
    rows = keyed(docs)
    joined = repeats.with_spans(rows, repeated_words(rows, length, gram))

    def clean(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                raw = np.frombuffer(data, np.uint8)
                at, to, _ = units.words_of(raw, np.array([0, len(raw)]))
                cut = repeats.merged(spans)
                keep = np.ones(len(at), bool)
                for lo, hi in cut:
                    keep[lo:hi] = False
                kept = b" ".join(data[a:b] for a, b in zip(at[keep].tolist(), to[keep].tolist()))
                out.append((len(at), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"lo": a, "hi": b} for a, b in cut]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        clean, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<lo:long,hi:long>>"
    )
