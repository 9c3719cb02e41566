"""Language identification by prediction with partial matching over bytes.

For every language a context tree counts which byte follows the last ``ORDER`` bytes or fewer. A byte
that a context has seen n of t times costs -log2(n / (t + d)) bits, d being the number of different
bytes seen there; another byte costs an escape, -log2(d / (t + d)), and is coded in the context that is
one byte shorter, down to equal chances. Counts are gathered from all learnt documents, then frozen,
and the code length of a text under each language is exact for them. The shortest wins.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm import units
from skytable.llm.common import bounded_batches

ORDER = 3
UNKNOWN = "und"
_MASKS = [(1 << (8 * k)) - 1 for k in range(ORDER + 2)]


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last ORDER + 1 bytes at each place as a number, and how many of them are in the row."""
    code = np.zeros(len(data), np.uint32)
    for k in range(ORDER + 1):
        code[k:] |= data[: len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    reach = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return code, np.minimum(reach, ORDER)


def counts(learnt: DataFrame) -> DataFrame:
    """(lang, known, code, n): how often each string of up to ORDER + 1 bytes ends at a place of (lang, text).

    ``known`` is the number of context bytes; only the first places of a text have fewer than ORDER.
    """

    def scan(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                code, n = (np.concatenate(x) for x in zip(*parts))
                values, inverse = np.unique(code, return_inverse=True)
                total = np.bincount(inverse, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values)), pa.array((values >> 32).astype(np.int32)), pa.array((values & 0xFFFFFFFF).astype(np.int64)), pa.array(total)],
                    names=["lang", "known", "code", "n"],
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, _, data, offsets in units.text_chunks(texts):
                    if len(data):
                        code, reach = _codes(data, offsets)
                        values, n = np.unique(code.astype(np.int64) | (reach << 32), return_counts=True)
                        held.setdefault(lang, []).append((values, n))
                        size += len(values)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    found = learnt.select("lang", "text").mapInArrow(scan, "lang string, known int, code long, n long")
    return found.groupBy("lang", "known", "code").agg(F.sum("n").alias("n"))


def contexts(counted: DataFrame) -> DataFrame:
    """(order, context, lang, symbol, n) of the context trees, with all contexts of all languages."""
    chains = F.explode(F.sequence(F.lit(0), F.col("known"))).alias("order")
    return (
        counted.select("lang", "code", "n", chains)
        .withColumn("context", F.shiftright("code", 8).bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("long") for m in _MASKS]), F.col("order") + 1)))
        .groupBy("order", "context", "lang", F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("symbol"))
        .agg(F.sum("n").alias("n"))
    )


def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted name among sorted ones, and whether it is there."""
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


class Model:
    """Frozen code lengths: the cost of every byte seen in a context, and of the escape from it, by language and order."""

    def __init__(self, langs: list[str], rows: dict[str, np.ndarray]):
        self.langs = langs
        order, context, lang, symbol, n = (rows[c] for c in ("order", "context", "lang", "symbol", "n"))
        self.trees = {}
        for o in range(ORDER + 1):
            for k in range(len(langs)):
                mine = np.flatnonzero((order == o) & (lang == k))
                if not len(mine):
                    continue
                code = context[mine].astype(np.int64) << 8 | symbol[mine]
                by_code = np.argsort(code)
                code, seen = code[by_code], n[mine][by_code].astype(np.float64)
                names, first, kinds = np.unique(code >> 8, return_index=True, return_counts=True)
                total = np.add.reduceat(seen, first)
                own = np.log2(np.repeat(total + kinds, kinds)) - np.log2(seen)
                self.trees[k, o] = code, own.astype(np.float32), names, np.log2((total + kinds) / kinds).astype(np.float32)

    def costs(self, code: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code under each language, ``reach`` context bytes being known."""
        out = np.zeros((len(code), len(self.langs)))
        for k in range(len(self.langs)):
            open_ = np.arange(len(code))
            for o in range(ORDER, -1, -1):
                if (k, o) not in self.trees:
                    continue
                grams, own, names, escape = self.trees[k, o]
                here = reach[open_] >= o
                at = open_[here]
                wanted = code[at] & _MASKS[o + 1]
                spot, hit = _find(grams, wanted)
                out[at[hit], k] += own[spot[hit]]
                missed = at[~hit]
                spot, met = _find(names, wanted[~hit] >> 8)
                out[missed[met], k] += escape[spot[met]]
                open_ = np.concatenate([open_[~here], missed])
            out[open_, k] += 8.0
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        code, reach = _codes(data, offsets)
        # Most places repeat a code of the chunk: each one is looked up once.
        names, place = np.unique(code.astype(np.int64) | reach << 32, return_inverse=True)
        cost = self.costs(names & 0xFFFFFFFF, names >> 32)[place]
        rows = np.flatnonzero(np.diff(offsets))
        out[rows] = np.add.reduceat(cost, offsets[:-1][rows], axis=0, dtype=np.float64)
        return out


# The model that a Python worker has loaded, by a name that no other model has had.
_loaded: dict[str, Model | None] = {}


def train(docs: DataFrame, usable: Column) -> tuple[list[str], dict[str, np.ndarray]]:
    """Frozen statistics from all documents (doc_id, text, lang) that meet ``usable`` and have text and lang.

    The counts cover the whole texts of all of them. One row for each different string of up to ORDER + 1
    bytes of a language comes to the driver and to each task: no context is dropped, so the table grows with the
    number of such strings.
    """
    learnt = bounded_batches(docs).filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    table = contexts(counts(learnt)).toArrow()
    named = table.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(named.dictionary.to_pylist())
    number = {lang: i for i, lang in enumerate(langs)}
    # Contexts have up to 24 bits.
    rows = {c: table.column(c).to_numpy().astype(t) for c, t in (("order", np.int8), ("context", np.int32), ("symbol", np.uint8), ("n", np.int64))}
    rows["lang"] = np.array([number[x] for x in named.dictionary.to_pylist()], np.int32)[named.indices.to_numpy()]
    return langs, rows


def predict(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``: doc_id and text are read, other columns are not used.

    The score is the winner's share of the probability that the code lengths give to all
    languages; of equal lengths the first name wins. A null or empty text or one without a letter
    is ``und`` with score 0, and so is every text if nothing was learnt. Whole texts are
    coded, repeated rows get one row each, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = Model(*shared.value) if shared.value[0] else None
        known = _loaded[name]
        for batch in batches:
            names, scores = [], []
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in units.text_chunks(batch.column(1), 1 << 18):
                if known is None:
                    names += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                bits = known.lengths(data, offsets)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                for row in range(hi - lo):
                    ok = bool(letters[lo + row])
                    names.append(known.langs[best[row]] if ok else UNKNOWN)
                    scores.append(float(share[row]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
