"""Suffix-array deduplication with a run-length index.

Anchors (see ``repeats``) bring together the byte strings that may recur. For each stretch of
anchors a run-compressed Burrows-Wheeler transform is built over the distinct segments. It is
kept as its runs only: the text place of each run's first and last character (the sampled run
ends) with the length of the match to the neighbouring suffix there. Inside a run that length
falls by one from each place to the next, so the matching statistics of all places are streamed
from the samples alone, and places with a match of ``length`` bytes or more are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm import repeats
from skytable.llm.common import keyed

WINDOW_BYTES = 400
GRAM_BYTES = 24
INDEX_BYTES = 1 << 20
_RANGE = "key long, lo long, hi long"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (symbols below 512), by prefix doubling; the end sorts first."""
    n = len(text)
    packed, width = np.zeros(n, np.int64), 7
    padded = np.concatenate([text.astype(np.int64), np.full(width, -1, np.int64)]) + 1
    for k in range(width):
        packed = packed * 513 + padded[k : k + n]
    order = np.argsort(packed, kind="stable")
    fresh = np.diff(packed[order]) != 0
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(fresh)])
        if rank[order[-1]] == n - 1:
            return order
        # Only suffixes that still share a rank are sorted again.
        same = np.concatenate([[False], ~fresh])
        same[:-1] |= same[1:]
        open_at = np.flatnonzero(same)
        who = order[open_at]
        after = np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + after
        step = np.argsort(key, kind="stable")
        order[open_at] = who[step]
        key = key[step]
        grown = np.concatenate([[False], (np.diff(key) != 0) & (np.diff(open_at) == 1)])
        fresh[open_at[grown] - 1] = True
        width *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a[i] and b[i]."""
    n = len(text)
    words = np.zeros(n + 4, np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.full(8, 511, np.uint64)])
    for k in range(4):
        words = words * np.uint64(512) + np.concatenate([padded[k : k + n], np.zeros(4, np.uint64)])
    length = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        x, y = a[active] + length[active], b[active] + length[active]
        inside = np.maximum(x, y) + 4 <= n
        equal = inside & (words[np.minimum(x, n)] == words[np.minimum(y, n)])
        length[active[equal]] += 4
        rest = active[~equal]
        for _ in range(3):
            x, y = a[rest] + length[rest], b[rest] + length[rest]
            inside = np.maximum(x, y) < n
            same = inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
            rest = rest[same]
            length[rest] += 1
        active = active[equal]
    return length


class RunIndex:
    """Run-compressed transform of a text: samples at run ends, and the match length to a neighbour there."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], -1)  # the transform; place 0 is a run of its own
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        tail = np.roll(head, -1)
        self.runs = int(head.sum())
        self.samples = []
        for ends, step in ((head, -1), (tail, 1)):
            rows = np.flatnonzero(ends)
            at, other = order[rows], rows + step
            inner = (other >= 0) & (other < n)
            match = np.zeros(len(rows), np.int64)
            match[inner] = common_prefix(text, at[inner], order[other[inner]])
            place = np.argsort(at)
            self.samples.append((at[place], match[place]))

    def statistics(self) -> np.ndarray:
        """For each place of the text, the longest match with a suffix that starts elsewhere."""
        best = np.zeros(self.n, np.int64)
        places = np.arange(self.n)
        for at, match in self.samples:
            last = np.searchsorted(at, places, "right") - 1
            known = last >= 0
            best[known] = np.maximum(best[known], match[last[known]] - (places[known] - at[last[known]]))
        return best


def _settle(length: int):
    def settle(anchor, n, copies, key, start, parts):
        sizes = np.array([len(p) + 1 for p in parts])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
        text[first + sizes - 1] = 0
        stats = RunIndex(text).statistics()
        at = np.concatenate([np.arange(f, f + k) for f, k in zip(first.tolist(), n)])
        owner = np.repeat(np.arange(len(parts)), n)
        # A separator equals only separators, so a match is cut at the end of its segment.
        stats = np.minimum(stats[at], (first + sizes - 1)[owner] - at)
        long = np.flatnonzero((stats >= length) & (np.array(copies)[owner] == 1))
        if not len(long):
            return
        head = np.ones(len(long), bool)
        head[1:] = (np.diff(long) != 1) | (np.diff(owner[long]) != 0)
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], len(long)) - 1
        own = owner[long[heads]]
        lo = np.array(start)[own] + at[long[heads]] - first[own]
        hi = np.array(start)[own] + at[long[ends]] - first[own] + length
        yield pa.RecordBatch.from_arrays([pa.array(np.array(key)[own]), pa.array(lo), pa.array(hi)], names=["key", "lo", "hi"])

    return settle


def repeated_bytes(docs: DataFrame, length: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """Byte ranges to remove: (key, spans) for ``keyed`` documents that have any."""
    windows = repeats.Windows(length, gram, words=False)
    found = repeats.recurring(docs, windows)
    kind = repeats.kinds(found)
    copied = found.join(kind.filter("copies > 1").select("anchor", "seg", "n"), ["anchor", "seg", "n"], "left_semi").select(
        "key", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (length - 1)).alias("hi")
    )
    few, many = repeats.mixed(kind, "single > 0")
    ranges = copied.unionByName(repeats.by_anchor(repeats.segments(docs, few, windows), _settle(length), _RANGE, INDEX_BYTES))
    if not many.isEmpty():
        rows = repeats.window_rows(repeats.segments(docs, many, windows), windows)
        often = rows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", "hash")
        ranges = ranges.unionByName(
            rows.filter("copies = 1")
            .join(often, ["anchor", "hash"], "left_semi")
            .select("key", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
        )
    return repeats.per_document(ranges)


def dedup_bytes(docs: DataFrame, length: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """Each document without its repeated bytes: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans).

    ``docs`` has doc_id and text; other columns are not used. A byte goes if a string of
    ``length`` bytes over it also starts at another place of any document. ``spans`` are the
    maximal removed ranges, ``kept`` the remaining bytes as text, where a character that lost
    a byte is left out whole; the digest is over the remaining bytes themselves.

    Null or empty text: no bytes, nothing removed. Shorter than ``length``: nothing removed.
    Rows that share an id but not a text are different documents; a repeated row is a copy like
    any other, so from ``length`` bytes on all of it goes. An empty table gives no rows.
    """
    rows = keyed(docs)
    joined = repeats.with_spans(rows, repeated_bytes(rows, length, gram))

    def clean(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                cut = repeats.merged(spans)
                parts, last = [], 0
                for lo, hi in cut:
                    parts.append(data[last:lo])
                    last = hi
                parts.append(data[last:])
                kept = b"".join(parts)
                shown = "".join(p.decode("utf-8", "ignore") for p in parts)
                out.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), shown, [{"lo": a, "hi": b} for a, b in cut]))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        clean,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<lo:long,hi:long>>",
    )


def keep_once(docs: DataFrame, length: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns and with the repeated bytes cut out of their texts.

    A character that lost a byte goes whole. ``n_chars``, if it is there, is counted anew. Rows whose text is
    repeated from end to end stay with an empty text; a null text stays null.
    """
    rows = keyed(docs, whole=True)
    joined = repeats.with_spans(rows, repeated_bytes(rows, length, gram))

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, spans):
            ranges = repeats.merged(found)
            if not ranges:
                out.append(text.as_py())
                continue
            data, last, parts = text.as_py().encode(), 0, []
            for lo, hi in ranges:
                parts.append(data[last:lo])
                last = hi
            out.append("".join(p.decode("utf-8", "ignore") for p in [*parts, data[last:]]))
        return pa.array(out, pa.string())

    # The text and its length are made once, beside the row, and take their places in it.
    shown = joined.select("row", F.arrow_udf(cut, "string").asNondeterministic()("text", "spans").alias("shown"))
    fields = {c: F.col(f"row.`{c}`") for c in docs.columns}
    fields["text"] = F.col("shown").cast(docs.schema["text"].dataType)
    if "n_chars" in fields:
        fields["n_chars"] = F.length("shown").cast(docs.schema["n_chars"].dataType)
    return shown.select(*[value.alias(c) for c, value in fields.items()])
