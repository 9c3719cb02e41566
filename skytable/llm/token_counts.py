"""How many tokens a byte-pair model makes of each text, without making them.

A text is a chain of symbols, one for each character. A heap holds every adjacent pair whose text is a piece, by rank and
then by place; the least is popped, the two symbols become one in a doubly linked list, and the pairs to its left and right
are pushed. A popped pair whose ends have moved meanwhile is skipped. The count is the number of first symbols
minus the number of merges; a character that is no piece and was never merged counts as its UTF-8 bytes.

Merges cannot cross two characters that stand side by side in no piece, so texts are cut there, and each distinct
span of a batch is merged once. The spans known so far are kept in a table of bounded bytes, which is emptied when full.

Nulls: a null text is empty and has no tokens; a null id stays null. Every row gives one row, so repeated rows
repeat. An empty table gives no rows. Columns of ``docs`` beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm import units
from skytable.llm.common import bounded_batches

SPACE = "▁"
# Text that is cut into spans at a time, and bytes of spans that a Python worker keeps.
CHUNK_BYTES = 2 << 20
KEPT_BYTES = 64 << 20
# What a kept span takes beside its letters.
_SPAN_COST = 120
_PROBES = ["", " ", "a", "The  quick\tbrown\nfox", "ａé ﬁ　\U0001f600", "<s>x</s>", "  1234567  ", "﻿​\xa0x"]


class Merges:
    """The pieces of a model file by rank, and which bytes stand side by side in some piece."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            codec = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        plain = [i for i in range(codec.get_piece_size()) if not (codec.is_byte(i) or codec.is_control(i) or codec.is_unknown(i))]
        pieces = sorted(((-codec.get_score(i), i, codec.id_to_piece(i).replace(SPACE, " ")) for i in plain))
        self.rank = {piece: rank for rank, (_, _, piece) in enumerate(pieces)}
        self.beside = np.zeros((256, 256), bool)
        self.beside[:, 0x80:0xC0] = True  # the bytes of one character
        for piece in self.rank:
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.beside[raw[:-1], raw[1:]] = True
        for text in _PROBES:
            if self.tokens(text) != len(codec.encode(text)):
                raise ValueError(f"{path} is no byte-pair model with byte pieces and plain normalisation")

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.of_span(" " + text.replace(SPACE, " ")) if text else 0

    def of_span(self, word: str) -> int:
        """Symbols that are left when no adjacent pair is a piece any more."""
        n, rank = len(word), self.rank
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A symbol is named by its first character; ``following`` is where the next one begins, 0 once it is merged away.
        heap = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := rank.get(word[a : a + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if following[a] != b or following[b] != end:
                continue
            following[a], following[b] = end, 0
            merges += 1
            if end < n:
                before[end] = a
                if (r := rank.get(word[a : following[end]])) is not None:
                    heapq.heappush(heap, (r, a, end, following[end]))
            if (c := before[a]) >= 0 and (r := rank.get(word[c:end])) is not None:
                heapq.heappush(heap, (r, c, a, end))
        more, a = 0, 0
        while a < n:
            if following[a] == a + 1 and word[a] not in rank:
                more += len(word[a].encode()) - 1
            a = following[a]
        return n - merges + more


def _spans(data: np.ndarray, offsets: np.ndarray, beside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(spans of all rows, first span of each row and their end); every text that is not empty gets a space in front."""
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    start = np.zeros(len(data), bool)
    start[1:] = ~beside[data[:-1], data[1:]]
    start[offsets[:-1][filled]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(starts, offsets)


def _counter(shared):
    kept: dict[bytes, int] = {}
    size = 0

    def count_chunk(merges: Merges, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        nonlocal size
        spans, firsts = _spans(data, offsets, merges.beside)
        coded = spans.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        each = np.empty(len(distinct), np.int64)
        for i, span in enumerate(distinct):
            known = kept.get(span)
            if known is None:
                if size > KEPT_BYTES:
                    kept.clear()
                    size = 0
                known = kept[span] = merges.of_span(span.decode())
                size += len(span) + _SPAN_COST
            each[i] = known
        total = np.zeros(len(spans) + 1, np.int64)
        np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)], out=total[1:])
        return total[firsts[1:]] - total[firsts[:-1]]

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = shared.value
        for texts in batches:
            parts = [
                count_chunk(merges, data, offsets) if len(data) else np.zeros(end - row, np.int64)
                for row, end, data, offsets in units.text_chunks(texts, CHUNK_BYTES)
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return F.arrow_udf(count, "long")


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, with the model file at ``path``, which the driver reads."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges(path))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = bounded_batches(docs).select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), _counter(shared)(F.replace(text, F.lit(SPACE), F.lit(" "))).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
