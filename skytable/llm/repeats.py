"""Where do windows of a fixed length occur more than once: the part that word and byte deduplication share.

Every window of ``length`` units is represented by one anchor, the gram of ``gram`` units in
it with the least hash (the leftmost of equals). Equal windows have equal anchors at equal
places, so a window can recur only if its anchor does, and only anchors travel:

1. each document gives its anchors, each with the run of window starts it stands for (its
   segment) and a hash of the segment's content;
2. anchors seen once are dropped by a hash aggregate and an equi join;
3. equal segments under one anchor are counted. Where all segments of an anchor are equal,
   nothing else need be read;
4. of the other anchors (mixed), one segment of each kind is cut from its text and sent to the
   partition of its anchor, where an index settles its windows. Anchors with very many kinds
   are settled window by window with a hash aggregate, so no key has to fit in one task.

No step makes pairs. A copy group of any size meets a count that is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm import units
from skytable.session import materialize

# Kinds of segments under one anchor above which its windows are settled one by one.
HOT_KINDS = 2_000
_PIECE = 1 << 20
_ANCHORS = "key long, anchor long, seg long, start long, n int"


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` units with anchors of ``gram`` units; ``words`` or bytes are the units."""

    length: int
    gram: int
    words: bool

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit values of a chunk and the first unit of each row."""
        if not self.words:
            return units.BYTE_VALUES[data], offsets
        starts, ends, firsts = units.words_of(data, offsets)
        return units.word_hashes(data, starts, ends), firsts

    def runs(self, values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in row, number of starts, anchor, segment hash) of each anchor's run of windows."""
        empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        count = len(values) - self.length + 1
        if count <= 0:
            return empty
        grams = units.gram_hashes(values, self.gram)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64(0xFFFFFFFF)
        least, width, size = (grams & ~low) | place, self.length - self.gram + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        anchor_at = (least & low).astype(np.int64)
        row = np.searchsorted(firsts, np.arange(count), "right") - 1
        valid = np.flatnonzero(np.arange(count) + self.length <= firsts[row + 1])
        if not len(valid):
            return empty
        at = anchor_at[valid]
        head = np.ones(len(valid), bool)
        head[1:] = (np.diff(at) != 0) | (np.diff(valid) != 1) | (np.diff(row[valid]) != 0)
        first = np.flatnonzero(head)
        n = np.diff(np.append(first, len(valid)))
        start = valid[first]
        seg = units.span_hashes(values, start, start + n + (self.length - 1))
        seg = units.mix(seg ^ (at[first] - start).astype(np.uint64))
        rows = row[start]
        return rows, start - firsts[rows], n, grams[at[first]], seg

    def pieces(self, values: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``runs`` with bounded arrays: a chunk with one very long row is cut into overlapping pieces."""
        if len(values) <= _PIECE + self.length:
            yield self.runs(values, firsts)
            return
        for p in range(0, len(values), _PIECE):
            end = min(len(values), p + _PIECE + self.length - 1)
            lo = int(np.searchsorted(firsts, p, "right")) - 1
            hi = int(np.searchsorted(firsts, end, "left"))
            inner = np.clip(firsts[lo : hi + 1], p, end) - p
            rows, start, n, anchor, seg = self.runs(values[p:end], inner)
            shift = np.where(rows == 0, p - firsts[lo], 0)
            yield rows + lo, start + shift, n, anchor, seg


def anchors(docs: DataFrame, windows: Windows) -> DataFrame:
    """One row per anchor of each document (key, text)."""

    def scan(batches):
        for batch in batches:
            keys = batch.column(0)
            for lo, _, data, offsets in units.text_chunks(batch.column(1)):
                for row, start, n, anchor, seg in windows.pieces(*windows.units(data, offsets)):
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(row + lo)), units.signed(anchor), units.signed(seg), pa.array(start), pa.array(n.astype(np.int32))],
                            names=["key", "anchor", "seg", "start", "n"],
                        )

    return docs.select("key", "text").mapInArrow(scan, _ANCHORS)


def recurring(docs: DataFrame, windows: Windows) -> DataFrame:
    """The anchors that occur at least twice, as a table."""
    found = anchors(docs, windows)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    return materialize(found.join(often, "anchor", "left_semi"))


def kinds(occurrences: DataFrame) -> DataFrame:
    """Equal segments under one anchor: how many copies, and the first (key, start)."""
    return materialize(
        occurrences.groupBy("anchor", "seg", "n").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start")).alias("first")
        )
    )


def segments(docs: DataFrame, wanted: DataFrame, windows: Windows) -> DataFrame:
    """``wanted`` (anchor, n, copies, key, start) with ``units``: the segment's bytes, cut from the text.

    For words the bytes are the words joined by one space.
    """
    per_doc = materialize(
        wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "n", "copies", "start")).alias("cuts"))
    )
    joined = docs.select("key", "text").join(per_doc, "key")

    def cut(batches):
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            for row in range(batch.num_rows):
                text, cuts = texts[row].as_py().encode(), lists[row].values
                anchor, n, copies, start = (cuts.field(k) for k in range(4))
                lo = start.to_numpy()
                hi = lo + n.to_numpy() + (windows.length - 1)
                if windows.words:
                    data = np.frombuffer(text, np.uint8)
                    at, to, _ = units.words_of(data, np.array([0, len(data)]))
                    out = [b" ".join(text[a:b] for a, b in zip(at[i:j].tolist(), to[i:j].tolist())) for i, j in zip(lo, hi)]
                else:
                    out = [text[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
                keys = pa.array(np.full(len(out), batch.column(0)[row].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [anchor, n, copies, keys, start, pa.array(out, pa.binary())],
                    names=["anchor", "n", "copies", "key", "start", "units"],
                )

    return joined.select("key", "text", "cuts").mapInArrow(cut, "anchor long, n int, copies long, key long, start long, units binary")


def by_anchor(cut: DataFrame, settle: Callable, schema: str, budget: int) -> DataFrame:
    """Send segments to the partition of their anchor; ``settle`` gets whole anchors of about ``budget`` bytes.

    ``settle`` takes lists (anchor, n, copies, key, start, units) in order of anchor, key and
    start, and yields record batches.
    """

    def stream(batches):
        held, size, last = [[] for _ in range(6)], 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if size >= budget and row[0] != last:
                    yield from settle(*held)
                    held, size = [[] for _ in range(6)], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[5])
                last = row[0]
        if held[0]:
            yield from settle(*held)

    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "key", "start")
    return dealt.mapInArrow(stream, schema)


def window_rows(cut: DataFrame, windows: Windows) -> DataFrame:
    """One row per window of each segment: (anchor, hash, copies, key, start)."""

    def scan(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            for lo, hi, data, offsets in units.text_chunks(batch.column(5), 1 << 18):
                values, firsts = windows.units(data, offsets)
                at = np.repeat(firsts[:-1], n[lo:hi])
                step = np.arange(len(at)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
                row = pa.array(np.repeat(np.arange(lo, hi), n[lo:hi]))
                hashes = units.span_hashes(values, at + step, at + step + windows.length)
                start = batch.column(4).take(row).to_numpy() + step
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), units.signed(hashes), batch.column(2).take(row), batch.column(3).take(row), pa.array(start)],
                    names=["anchor", "hash", "copies", "key", "start"],
                )

    return cut.mapInArrow(scan, "anchor long, hash long, copies long, key long, start long")


def mixed(kind: DataFrame, needs: str = "true") -> tuple[DataFrame, DataFrame]:
    """Segments of anchors with different contents: those with few kinds, and those with very many.

    ``needs`` is a condition over an anchor's kinds (``single``: the number of kinds with one copy).
    """
    per = kind.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")
    ).filter(f"kinds > 1 AND ({needs})")
    rows = kind.join(per, "anchor").select(
        "anchor", "n", "copies", F.col("first.key").alias("key"), F.col("first.start").alias("start"), "kinds"
    )
    rows = materialize(rows)
    few, many = F.col("kinds") <= HOT_KINDS, F.col("kinds") > HOT_KINDS
    return rows.filter(few).drop("kinds"), rows.filter(many).drop("kinds")


def per_document(ranges: DataFrame) -> DataFrame:
    """(key, spans): all removed ranges [lo, hi) of a document, as a table."""
    return materialize(ranges.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document with its ranges; null where nothing is removed."""
    return docs.join(spans, "key", "left")


def merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges of one row; ranges that overlap or touch become one."""
    if not spans.is_valid or not len(spans.values):
        return []
    lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1))
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    head = np.ones(len(lo), bool)
    head[1:] = lo[1:] > reach[:-1]
    first = np.flatnonzero(head)
    return list(zip(lo[first].tolist(), reach[np.append(first[1:], len(lo)) - 1].tolist()))
