"""Benchmark decontamination: training passages query a BM25 index of test items with block-max WAND.

The index holds the test items: for each term its postings, with impacts divided by the item's score for
itself, so one threshold fits all items. Items stand in blocks, and each list knows its greatest impact
overall and in each block. Every document is cut into passages of twice the longest item, one
item apart, so an item lies whole in some passage. A passage is dropped when its terms' list
bounds, then their block bounds, stay below the threshold; in the blocks that are left, items are
scored in order of id with pivots, and all items at the threshold or above are retrieved.
A retrieved item counts when the passage holds its question and its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import bounded_batches

THRESHOLD = 0.5
OVERLAP = 0.6
GRAM = 3
BLOCK = 1
K1, B = 1.2, 0.75
# Items in one index, which every task holds; more items make more indexes, each queried by all passages.
INDEX_ITEMS = 50_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the last sentence, or what follows the last question mark, answers."""
    head, mark, tail = text.rpartition("?")
    if mark and terms(tail) and terms(head):
        return terms(head), terms(tail)
    sentences = [s for s in _SENTENCE.split(text) if terms(s)]
    if len(sentences) > 1:
        return terms(" ".join(sentences[:-1])), terms(sentences[-1])
    words = terms(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def _grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _share(part: tuple[int, set], words: list[str]) -> float:
    """Share of a part's grams that ``words`` hold; a part shorter than ``GRAM`` is one gram."""
    n, grams = part
    return len(grams & _grams(words, n)) / len(grams) if grams else 1.0


@dataclass
class Index:
    """Postings of one group of items."""

    items: list[int]
    texts: list[str]
    number: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, items, texts, frequency: dict[str, int], total: int, mean: float) -> Index:
        index = cls(list(items), list(texts))
        lists: dict[str, list[tuple[int, float]]] = {}
        for i, text in enumerate(index.texts):
            words = terms(text)
            count: dict[str, int] = {}
            for w in words:
                count[w] = count.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: np.log1p((total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in count.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                lists.setdefault(w, []).append((i, x / own))
        names = sorted(lists)
        index.number = {w: k for k, w in enumerate(names)}
        index.ends = np.concatenate([[0], np.cumsum([len(lists[w]) for w in names])]).astype(np.int64)
        flat = [p for w in names for p in lists[w]]
        index.item = np.array([i for i, _ in flat], np.int64)
        index.impact = np.array([x for _, x in flat])
        index.most = np.array([max(x for _, x in lists[w]) for w in names])
        blocks = -(-len(index.items) // BLOCK)
        index.blocks = blocks
        best: list[dict[int, float]] = []
        for w in names:
            top: dict[int, float] = {}
            for i, x in lists[w]:
                top[i // BLOCK] = max(top.get(i // BLOCK, 0.0), x)
            best.append(top)
        index.block_ends = np.concatenate([[0], np.cumsum([len(t) for t in best])]).astype(np.int64)
        index.block = np.array([b for t in best for b in sorted(t)], np.int64)
        index.block_most = np.array([t[b] for t in best for b in sorted(t)])
        # Lists over more than a quarter of the blocks bound by one number instead of by block.
        index.wide = np.diff(index.block_ends) * 4 > max(4, blocks)
        index.longest = max((len(terms(t)) for t in index.texts), default=0)
        index.parts = [tuple((n := min(GRAM, len(p)), _grams(p, n)) for p in question_and_answer(t)) for t in index.texts]
        return index

    def candidate_blocks(self, passage: np.ndarray, term: np.ndarray, count: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block bounds reach the threshold; (passage, term) are distinct pairs."""
        bound = np.bincount(passage, weights=self.most[term], minlength=count)
        open_ = bound[passage] >= threshold
        passage, term = passage[open_], term[open_]
        wide = self.wide[term]
        base = np.bincount(passage[wide], weights=self.most[term[wide]], minlength=count)
        passage, term = passage[~wide], term[~wide]
        size = np.diff(self.block_ends)[term]
        owner = np.repeat(passage, size)
        at = np.repeat(self.block_ends[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, inverse = np.unique(owner * self.blocks + self.block[at], return_inverse=True)
        bound = np.bincount(inverse, weights=self.block_most[at], minlength=len(key)) + base[key // self.blocks]
        # Where wide lists alone reach the threshold, every block is a candidate.
        full = np.flatnonzero(base >= threshold)
        if len(full):
            every = (full[:, None] * self.blocks + np.arange(self.blocks)).ravel()
            keep = np.union1d(key[bound >= threshold], every)
        else:
            keep = key[bound >= threshold]
        return keep // self.blocks, keep % self.blocks

    def wand(self, query: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of one block with a score of at least ``threshold`` for the distinct query terms."""
        lists = []
        for t in query.tolist():
            lo, hi = self.ends[t], self.ends[t + 1]
            a = lo + np.searchsorted(self.item[lo:hi], block * BLOCK)
            b = lo + np.searchsorted(self.item[lo:hi], (block + 1) * BLOCK)
            if a < b:
                s = self.block_ends[t] + np.searchsorted(self.block[self.block_ends[t] : self.block_ends[t + 1]], block)
                lists.append([int(a), int(b), float(self.block_most[s])])
        found = []
        while lists:
            lists.sort(key=lambda x: self.item[x[0]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[2]
                if bound >= threshold:
                    pivot = int(self.item[x[0]])
                    break
            if pivot is None:
                break
            if self.item[lists[0][0]] == pivot:
                score = 0.0
                for x in lists:
                    if self.item[x[0]] == pivot:
                        score += float(self.impact[x[0]])
                        x[0] += 1
                if score >= threshold:
                    found.append((pivot, score))
            else:
                for x in lists:
                    if self.item[x[0]] < pivot:
                        x[0] += int(np.searchsorted(self.item[x[0] : x[1]], pivot))
            lists = [x for x in lists if x[0] < x[1]]
        return found


def indexes(items: DataFrame, group: int = INDEX_ITEMS) -> list[Index]:
    """Indexes of all items (item_id, text), each of at most ``group`` items; statistics cover all of them.

    Items without words are left out, and equal rows count once.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_\p{M}]+)"), F.lit(1))
    rows = rows.filter(F.size(words) > 0)
    held = sorted((r.item_id if r.item_id is not None else -1, r.text) for r in rows.toLocalIterator())
    held = [(i, t) for i, t in held if terms(t)]
    frequency: dict[str, int] = {}
    total = 0
    for _, text in held:
        found = terms(text)
        total += len(found)
        for w in set(found):
            frequency[w] = frequency.get(w, 0) + 1
    mean = total / max(1, len(held))
    return [
        Index.build(*zip(*held[k : k + group]), frequency, len(held), mean) for k in range(0, len(held), group)
    ]


def _hits(index: Index, texts: list[str | None], threshold: float, overlap: float) -> dict[tuple[int, int], tuple]:
    """(row, item) -> (score, question, answer) of a few texts: the best passage of each."""
    get, step, width = index.number.get, max(1, index.longest), max(1, len(index.number))
    words = [terms(t) for t in texts]
    spans = [(r, a) for r, w in enumerate(words) for a in range(0, max(1, len(w) - step), step)]
    ids = [np.array([get(x, -1) for x in w], np.int64) for w in words]
    key = [(part := ids[r][a : a + 2 * step])[part >= 0] + p * width for p, (r, a) in enumerate(spans)]
    pairs = np.unique(np.concatenate([*key, np.zeros(0, np.int64)]))
    passage, term = pairs // width, pairs % width
    ends = np.searchsorted(passage, np.arange(len(spans) + 1))
    best: dict[tuple[int, int], tuple] = {}
    for p, block in zip(*(x.tolist() for x in index.candidate_blocks(passage, term, len(spans), threshold))):
        r, a = spans[p]
        for item, score in index.wand(term[ends[p] : ends[p + 1]], block, threshold):
            shares = [_share(part, words[r][a : a + 2 * step]) for part in index.parts[item]]
            if min(shares) >= overlap:
                best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (score, *shares))
    return best


_ROWS = 128  # texts whose passages are bounded together


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Documents with test items in them: (doc_id, item_id, score, question, answer), one row for each pair.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not used. Every passage of
    every whole text is a query. ``score`` is the best normalised BM25 score of a passage for the item,
    ``question`` and ``answer`` are the shares of their word trigrams that the passage holds.
    Null and empty texts hold nothing. Rows that repeat give rows that repeat; a null doc_id stays null, a null
    item_id is -1. No items or no documents give no rows.
    """
    schema = "doc_id long, item_id long, score double, question double, answer double"
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    out = None
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most INDEX_ITEMS items

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                found = []
                for first in range(0, batch.num_rows, _ROWS):
                    best = _hits(index, batch.column(1).slice(first, _ROWS).to_pylist(), threshold, overlap)
                    found += [(batch.column(0)[first + r].as_py(), index.items[i], *v) for (r, i), v in sorted(best.items())]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["doc_id", "item_id", "score", "question", "answer"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item.

    Only texts go to Python and only a mark comes back. Rows with a null or empty text stay, repeated rows stay or go
    together, and without items all rows stay. Other columns may have any name.
    """

    def clean(shared):
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                out = np.ones(len(batch), bool)
                for first in range(0, len(batch), _ROWS):
                    for r, _ in _hits(shared.value, batch.slice(first, _ROWS).to_pylist(), threshold, overlap):
                        out[first + r] = False
                yield pa.array(out)

        return F.arrow_udf(run, "boolean")

    kept = bounded_batches(docs)
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most INDEX_ITEMS items
        kept = kept.filter(clean(shared)(F.col("text").cast("string")))
    return kept
