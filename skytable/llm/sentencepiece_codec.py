"""SentencePiece encoding and decoding as a relational lattice.

Distinct words are counted over all documents. Each word is exploded to its substrings of at most
the longest piece, the substrings are equi-joined to the piece table, and the edges are grouped by
word again and folded with Spark's higher-order ``aggregate``:

* files of the unigram kind: Viterbi, the path of the greatest sum of scores;
* files of the BPE kind: merges in the order of scores over the same lattice, because the best path
  by summed ranks is not what such a file means (``fold`` can ask for either).

Words split wherever two characters stand side by side in no piece (so before spaces and around line
ends, and at most punctuation), hence the pieces of a text are those of its words. The most frequent words form a dictionary of bounded
size that every task holds; the others come by a join to their documents, whose texts are packed for it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.llm import units
from skytable.llm.common import BATCH_BYTES, bounded_batches
from skytable.session import materialize

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Words in the dictionary of each task, at most; about 16 bytes each.
DICTIONARY_WORDS = 1 << 19
# Bytes of words, hashes and counts that a task holds before it hands them on.
_HELD_BYTES = 8 << 20
# Words above this length are folded by a heap, whose work does not grow with the square of the length.
LONG_WORD = 48
# Characters of text for each partition of distinct words: least and most.
LEAST_CHARS, PARTITION_CHARS = 250_000, 2_000_000
# Bytes of text that a task cuts into words at once.
_CHUNK_BYTES = 1 << 18
_UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """What encoding needs of a model file: pieces, scores, the byte pieces and the kind."""

    def __init__(self, path: str = DEFAULT_MODEL, model: bytes | None = None):
        import sentencepiece

        raw = model if model is not None else open(path, "rb").read()
        codec = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(codec.get_piece_size())
        self.pieces = [codec.id_to_piece(i) for i in ids]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if codec.is_byte(i)}
        special = {i for i in ids if codec.is_byte(i) or codec.is_control(i) or codec.is_unknown(i) or codec.is_unused(i)}
        self.rows = [(self.pieces[i], i, float(codec.get_score(i))) for i in ids if i not in special]
        self.singles = {ord(p): i for p, i, _ in self.rows if len(p) == 1}
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.unknown = codec.unk_id()
        self.unknown_score = min(s for _, _, s in self.rows) - _UNKNOWN_PENALTY
        self.special = special
        # The kind shows in one short text: only merges follow the scores, not their sum.
        self.kind = "unigram" if _field(raw, (2, 3)) == 1 else "bpe"
        # Bytes that stand side by side in some piece, where a character ends and the next begins; a character is never cut.
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for piece, _, _ in self.rows:
            raw_piece = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            self.joined[raw_piece[:-1], raw_piece[1:]] = True
        if any(SPACE in p.lstrip(SPACE) or (len(p) > 1 and "\n" in p) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p, _, _ in self.rows):
            raise ValueError("pieces that reach over words are not supported")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, id int, score double")

    def expand(self, ids) -> list[int]:
        """Negative numbers stand for single characters: their piece, else their bytes, or the unknown piece."""
        out = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif (piece := self.singles.get(-1 - i)) is not None:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - i).encode())
            else:
                out.append(self.unknown)
        return out


def _field(raw: bytes, path: tuple[int, ...]) -> int:
    """An integer field of a protocol buffer message, by field numbers; 1 if it is not there."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    found = 1
    while at < len(raw):
        tag = number()
        kind, name = tag & 7, tag >> 3
        if kind == 0:
            value = number()
            if len(path) == 1 and name == path[0]:
                found = value
        elif kind == 2:
            size = number()
            if len(path) > 1 and name == path[0]:
                return _field(raw[at : at + size], path[1:])
            at += size
        else:
            at += 4 if kind == 5 else 8
    return found


def _word_spans(data: np.ndarray, offsets: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with the leading space that encoding adds, cut into words: (data, starts, ends, first word of each row).

    A text is cut before each character that stands beside the one before it in no piece (``joined``, by bytes).
    """
    filled = np.diff(offsets) > 0
    where = offsets[:-1][filled]
    data = np.insert(data, where, 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    start = np.zeros(len(data), bool)
    start[1:] = ~joined[data[:-1], data[1:]]
    start[offsets[:-1][filled]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words data[start:end] as an Arrow array."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _counted(n: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words.cast(pa.binary()).cast(pa.string()), pa.array(n)], names=["raw", "n"])


def _partitions(size: int) -> int:
    """Partitions for the distinct words of ``size`` characters.

    Words grow about as the square root of the text, and those of one partition are held with their edges. However few of the
    words are equal, a partition has no more than those of ``PARTITION_CHARS``.
    """
    return max(1, -(-size // min(PARTITION_CHARS, max(LEAST_CHARS, 50 * math.isqrt(size)))))


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(raw, n) of all distinct words, as they stand in the texts; only words and counts are shuffled."""
    joined = vocabulary.joined

    def scan(batches):
        # Words of some chunks as (hashes, counts, Arrow words), each chunk's distinct.
        held: list[tuple] = []

        def together():
            hashes, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, n).astype(np.int64)
            words = pa.concat_arrays([h[2] for h in held]).take(pa.array(first))
            return values, counts, words

        def room(words: tuple) -> int:
            return sum(column.nbytes for column in words)

        size = 0
        for batch in batches:
            for _, _, raw, offsets in units.text_chunks(batch.column(0), _CHUNK_BYTES):
                if not len(raw):
                    continue
                data, starts, ends, _ = _word_spans(raw, offsets, joined)
                hashes = units.word_hashes(data, starts, ends).view(np.int64)
                values, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((values, n, _cut(data, starts[first], ends[first])))
                size += room(held[-1])
                if size > _HELD_BYTES:
                    held = [together()]
                    size = room(held[0])
                    if size > _HELD_BYTES // 2:
                        yield _counted(*held[0][1:])
                        held, size = [], 0
        if held:
            yield _counted(*together()[1:])

    # Words were counted within tasks; partitions are small, because edges are grouped in memory.
    size = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    found = docs.select("text").mapInArrow(scan, "raw string, n long").repartition(_partitions(size), "raw")
    return found.groupBy("raw").agg(F.sum("n").alias("n"))


def _marked() -> Column:
    """The word with the space mark for spaces, as pieces have it."""
    return F.translate("raw", " ", SPACE)


_KEY = 1 << 16
# An edge of the merging kind is one number that sorts as merges are chosen: (rank of the score, start, end, id).
_RANK_BITS, _PLACE_BITS, _ID_BITS = 20, 6, 24
# Set beside the id of a piece that can stand beside another one with which it makes a piece of no worse score.
_EARLIER = 1 << _ID_BITS - 1


def _completes(ranks: dict[str, int]) -> set[str]:
    """Pieces of which a longer one, with one more piece or character, comes no later in the order of merges."""
    found = set()
    for piece, rank in ranks.items():
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            for part, rest in ((left, right), (right, left)):
                if ranks.get(part, -1) >= rank and (len(rest) == 1 or rest in ranks):
                    found.add(part)
    return found


def _spans(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Words up to ``LONG_WORD`` exploded to their substrings of ``shortest`` to ``longest`` characters, from ``s`` on and ``l`` long.

    Each word, also a longer one, gives one row with ``l = 0`` besides.
    """
    fits = F.col("length") <= LONG_WORD
    starts = F.explode(F.sequence(F.lit(1), F.when(fits, F.col("length")).otherwise(1)))
    lengths = F.when(
        fits & (F.col("length") - F.col("s") + 1 >= shortest), F.sequence(F.lit(shortest), F.least(F.lit(longest), F.col("length") - F.col("s") + 1))
    )
    lengths = F.explode(F.when(F.col("s") == 1, F.concat(F.array(F.lit(0)), F.coalesce(lengths, F.array().cast("array<int>")))).otherwise(lengths))
    cut = words.select("raw", "n", _marked().alias("word"), F.length("raw").alias("length")).select("*", starts.alias("s")).select("*", lengths.alias("l"))
    return cut.withColumn("piece", F.substring("word", F.col("s"), F.col("l"))).drop("word")


def merge_lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(raw, n, word, edges) of words: the pieces of two characters and more, sorted as merges are chosen; none beyond ``LONG_WORD``.

    ``code`` is the number of an edge, ``ends`` and ``inner`` have bits for the borders that it needs and those between them.
    """
    ranks = {score: rank for rank, score in enumerate(sorted({s for _, _, s in vocabulary.rows}, reverse=True))}
    if len(ranks) > 1 << _RANK_BITS or len(vocabulary.pieces) > _EARLIER:
        raise ValueError("the piece table is too large for the numbers of edges")
    completes = _completes({p: ranks[s] for p, _, s in vocabulary.rows if len(p) > 1})
    rows = [(p, (ranks[s] << 2 * _PLACE_BITS + _ID_BITS) + (_EARLIER if p in completes else 0) + i) for p, i, s in vocabulary.rows if len(p) > 1]
    pieces = words.sparkSession.createDataFrame(rows, "piece string, code long")  # bounded by the vocabulary file
    place = F.col("s") - 1
    code = F.col("code") + F.shiftleft((place * (1 << _PLACE_BITS) + place + F.col("l")).cast("long"), _ID_BITS)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    ends, inner = bit(place) + bit(place + F.col("l")), bit(place + F.col("l")) - bit(place + 1)
    edge = F.when(F.col("code").isNotNull(), F.struct(code.alias("code"), ends.alias("ends"), inner.alias("inner")))
    joined = _spans(words, 2, vocabulary.longest).join(F.broadcast(pieces), "piece", "left").filter("code IS NOT NULL OR l = 0")
    # Words are already dealt, so grouping their edges again needs no shuffle.
    return joined.groupBy("raw", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges")).withColumn("word", _marked())


def viterbi_lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(raw, n, length, edges) of words: start and end are mapped to (score, id); none beyond ``LONG_WORD``.

    Every single character has an edge; without a piece its id is minus one minus its code point.
    """
    pieces = vocabulary.frame(words.sparkSession)  # bounded by the vocabulary file
    edge = F.when(F.col("l") > 0, F.struct(
        ((F.col("s") - 1) * _KEY + F.col("s") + F.col("l") - 1).cast("int").alias("at"),
        F.struct(
            F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("score"), F.coalesce("id", -1 - F.ascii("piece")).alias("id")
        ).alias("edge"),
    ))
    joined = _spans(words, 1, vocabulary.longest).join(F.broadcast(pieces), "piece", "left").filter("id IS NOT NULL OR l < 2")
    return joined.groupBy("raw", "n", "length").agg(F.map_from_entries(F.collect_list(edge)).alias("edges"))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _edge(a: Column, b: Column) -> Column:
    return F.try_element_at("edges", (a * _KEY + b).cast("int"))


def merge_fold() -> Column:
    """Pieces by merges: of neighbours that form a piece, those of the best score first, the leftmost of equals.

    The borders between pieces are the bits of one number. An edge can be merged if its ends are borders
    and one border lies between them; the first such edge in sorted order is the next merge. One pass over
    the sorted edges finds all merges, unless a merge lets an edge before it be merged, which then comes next:
    that can only be after a piece marked ``_EARLIER``. Words where it happens are merged step by step.
    Characters that are left alone give minus one minus their code point.
    """
    nothing, low, edges = F.lit(0).cast("long"), (1 << 32) - 1, F.col("edges")
    start = lambda e: F.shiftright(e["code"], _PLACE_BITS + _ID_BITS).bitwiseAND((1 << _PLACE_BITS) - 1)
    first = F.call_function("shiftleft", F.lit(1).cast("long"), F.length("word") + 1) - 1
    stands = lambda borders, e: borders.bitwiseAND(e["ends"]) == e["ends"]
    fits = lambda borders, e: (F.bit_count(borders.bitwiseAND(e["inner"])) == 1) & stands(borders, e)
    without = lambda borders, e: borders.bitwiseAND(F.bitwise_not(e["inner"]))

    def in_order() -> Column:
        """The borders that are left, below zero if an edge would have had to be merged before one that was."""

        def step(borders: Column, e: Column) -> Column:
            def merged(after: Column) -> Column:
                again = F.exists(edges, lambda o: (o["code"] < e["code"]) & fits(after, o))
                return F.when((e["code"].bitwiseAND(_EARLIER) != nothing) & again, after.bitwiseOR(F.lit(-(2**63)))).otherwise(after)

            return F.when(fits(borders, e), _bind(without(borders, e), merged)).otherwise(borders)

        return F.aggregate(edges, first, step)

    def by_steps() -> Column:
        def step(state: Column, _: Column) -> Column:
            # Borders only vanish, so an edge that lost an end, or has none between its ends, is out for good.
            def after(borders: Column) -> Column:
                held = lambda e: stands(borders, e) & (borders.bitwiseAND(e["inner"]) != nothing)
                return F.struct(borders.alias("borders"), F.filter(state["left"], held).alias("left"))

            merged = _bind(
                F.get(F.filter(state["left"], lambda e: fits(state["borders"], e)), 0),
                lambda e: F.when(e.isNull(), F.struct(state["borders"].alias("borders"), F.slice(state["left"], 1, 0).alias("left"))).otherwise(
                    _bind(without(state["borders"], e), after)
                ),
            )
            return F.when(F.size(state["left"]) == 0, state).otherwise(merged)

        state = F.struct(first.alias("borders"), edges.alias("left"))
        return F.aggregate(F.sequence(F.lit(1), F.length("word")), state, step, lambda state: state["borders"])

    def ids(borders: Column) -> Column:
        # A piece is an edge whose ends are borders with none between; other places are single characters. Both go by their start.
        at_start = lambda at, value: F.shiftleft(at.cast("long"), 32) + value + (1 << 31)
        whole = F.filter(edges, lambda e: (borders.bitwiseAND(e["inner"]) == nothing) & stands(borders, e))
        pieces = F.transform(whole, lambda e: at_start(start(e), e["code"].bitwiseAND(_EARLIER - 1)))
        alone = F.filter(F.sequence(F.lit(0), F.length("word") - 1), lambda at: F.call_function("shiftright", borders, at).bitwiseAND(3) == 3)
        singles = F.transform(alone, lambda at: at_start(at, -1 - F.ascii(F.substring("word", at + 1, F.lit(1)))))
        return F.transform(F.sort_array(F.concat(pieces, singles)), lambda x: (x.bitwiseAND(low) - (1 << 31)).cast("int"))

    borders = _bind(in_order(), lambda quick: F.when(quick >= 0, quick).otherwise(by_steps()))
    return _bind(borders, ids)


def viterbi_fold(longest: int) -> Column:
    """Pieces of the path with the greatest sum of scores; of equal paths into a place, the one with the longest last piece."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))

    def step(state: Column, end: Column) -> Column:
        def arrive(start: Column) -> Column:
            return _bind(
                _edge(start, end),
                lambda e: F.when(
                    e.isNotNull(),
                    F.struct((F.get(state, start)["score"] + e["score"]).alias("score"), (-start).alias("left"), e["id"].alias("id")),
                ),
            )

        best = F.array_max(F.transform(F.sequence(F.greatest(F.lit(0), end - longest), end - 1), arrive))
        return _bind(
            best,
            lambda p: F.array_append(
                state, F.struct(p["score"].alias("score"), F.array_append(F.get(state, -p["left"])["ids"], p["id"]).alias("ids"))
            ),
        )

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.col("length")), first, step), -1)["ids"]


def _long_words(pieces: dict[str, tuple[float, int]], longest: int, unknown: float, kind: str):
    """The same folds for one long word, in time that grows with its length."""

    def single(c: str) -> tuple[float, int]:
        return pieces.get(c, (unknown, -1 - ord(c)))

    def viterbi(word: str) -> list[int]:
        best = [(0.0, 0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + e[0], -s, e[1]) for s in range(max(0, end - longest), end) if (e := pieces.get(word[s:end]) or (single(word[s]) if end - s == 1 else None))]
            best.append(max(options))
        out, at = [], len(word)
        while at:
            out.append(best[at][2])
            at = -best[at][1]
        return out[::-1]

    def merges(word: str) -> list[int]:
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (e := pieces.get(word[a : end[b]])):
                heapq.heappush(heap, (-e[0], a, b, end[b]))

        for a in range(n):
            offer(a)
        gone = [False] * n
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if gone[a] or end[a] != b or gone[b] or end[b] != stop:
                continue
            gone[b], end[a] = True, stop
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            word_ = word[a : end[a]]
            out.append((pieces.get(word_) or single(word_))[1])
            a = end[a]
        return out

    return viterbi if kind == "unigram" else merges


def encoded_words(docs: DataFrame, vocabulary: Vocabulary, fold: str | None = None) -> DataFrame:
    """(hash, n, ids) of all distinct words, as a table."""
    kind = fold or vocabulary.kind
    words = word_counts(docs, vocabulary)
    lattice, ids = (viterbi_lattice, viterbi_fold(vocabulary.longest)) if kind == "unigram" else (merge_lattice, merge_fold())
    table = {p: (s, i) for p, i, s in vocabulary.rows}
    shared = docs.sparkSession.sparkContext.broadcast((table, vocabulary.longest, vocabulary.unknown_score, kind))

    def hashed(batches):
        """(hash, n, ids) of rows (raw, n, ids); words without ids are the long ones."""
        encode = None
        for batch in batches:
            raw, n, found = batch.columns
            if found.null_count:
                encode = encode or _long_words(*shared.value)
                long = [encode(w.replace(" ", SPACE)) for w in raw.filter(found.is_null()).to_pylist()]
                # Behind the others, they are taken in the places of the nulls.
                at = np.arange(len(found))
                at[found.is_null().to_numpy(zero_copy_only=False)] = len(found) + np.arange(len(long))
                found = pa.concat_arrays([found, pa.array(long, found.type)]).take(pa.array(at))
            for lo, hi, data, offsets in units.text_chunks(raw):
                hashes = units.signed(units.word_hashes(data, offsets[:-1], offsets[1:]))
                yield pa.RecordBatch.from_arrays([hashes, n.slice(lo, hi - lo), found.slice(lo, hi - lo)], names=["hash", "n", "ids"])

    short = F.when(F.length("raw") <= LONG_WORD, ids)
    conf, name = docs.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(name)
    try:
        # Edges of one partition's words fit in memory by PARTITION_CHARS; else they are sorted and spilled.
        conf.set(name, str(PARTITION_CHARS))
        return materialize(lattice(words, vocabulary).select("raw", "n", short.alias("ids")).mapInArrow(hashed, "hash long, n long, ids array<int>"))
    finally:
        conf.set(name, before)


def _pack(rows: pa.Table, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, offsets and ids of words, expanded to final ids."""
    hashes = rows.column("hash").to_numpy()
    lists = rows.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    order = np.argsort(hashes)
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    sizes = np.diff(ends)[order]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(ends[:-1][order], sizes) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    flat = flat[take]
    odd = np.flatnonzero(flat < 0)
    if len(odd):
        expanded = [vocabulary.expand([i]) for i in flat[odd].tolist()]
        grown = np.ones(len(flat), np.int64)
        grown[odd] = [len(e) for e in expanded]
        at = np.concatenate([[0], np.cumsum(grown)])
        out = np.repeat(flat, grown)
        for k, e in zip(odd.tolist(), expanded):
            out[at[k] : at[k + 1]] = e
        flat, offsets = out, at[offsets]
    kind = np.uint16 if len(vocabulary.pieces) <= 65_536 else np.int32
    return hashes[order], offsets.astype(np.uint32), flat.astype(kind)


def encode(docs: DataFrame, vocabulary: Vocabulary, fold: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text; other columns are not used): the pieces of the whole text.

    Null and empty texts give no ids. A character without a piece gives its bytes' pieces, or the
    unknown piece where the file has none. Texts, words and lists may have any length. Repeated
    rows give equal rows, and an empty table gives none.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    words = encoded_words(rows, vocabulary, fold)
    # The dictionary holds words from a power of two of occurrences on, so that it fits.
    level = F.floor(F.log2("n")).cast("int").alias("level")
    held, least = 0, 62
    for r in sorted(words.groupBy(level).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["level"]):  # at most 64 levels
        held += r["c"]
        if held > DICTIONARY_WORDS:
            break
        least = r["level"]
    frequent = words.filter(F.col("n") >= F.lit(1 << least).cast("long")).select("hash", "ids")
    shared = spark.sparkContext.broadcast(_pack(frequent.toArrow(), vocabulary))
    rare = words.filter(F.col("n") < F.lit(1 << least).cast("long")).select("hash", "ids")

    # Once for each worker, not with each task.
    joined, pieces = vocabulary.joined, spark.sparkContext.broadcast(vocabulary)

    def find(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        return at, (known[at] == hashes) if len(known) else np.zeros(len(hashes), bool)

    def missing(batches):
        for batch in batches:
            for lo, _, raw, offsets in units.text_chunks(batch.column(1), _CHUNK_BYTES):
                if not len(raw):
                    continue
                data, starts, ends, firsts = _word_spans(raw, offsets, joined)
                hashes = units.word_hashes(data, starts, ends).view(np.int64)
                values, inverse = np.unique(hashes, return_inverse=True)
                lost = np.flatnonzero(~find(values, shared.value[0])[1][inverse])
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))[lost]
                # Once for each text and word.
                _, once = np.unique(row * len(values) + inverse[lost], return_index=True)
                row, lost = row[once], lost[once]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(hashes[lost])], names=["text_hash", "hash"])

    def pack(batches):
        """Texts as small as they get, for they are shuffled."""
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t.as_buffer()) for t in batch.column(2).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], names=["doc_id", "text_hash", "packed"])

    def unpack(texts: pa.Array):
        """The rows of a batch in runs of bounded size: (first row, texts)."""
        if not pa.types.is_binary(texts.type):
            yield 0, texts
            return
        reader, held, size, first = zstandard.ZstdDecompressor(), [], 0, 0
        for row in range(len(texts)):
            held.append(reader.decompress(texts[row].as_buffer()))
            size += len(held[-1])
            if size >= BATCH_BYTES or row == len(texts) - 1:
                yield first, pa.array(held, pa.large_binary())
                held, size, first = [], 0, row + 1

    def assemble(batches):
        known, ends, flat = shared.value
        ends = ends.astype(np.int64)
        for batch in batches:
            for first, texts in unpack(batch.column(1)):
                for lo, hi, raw, offsets in units.text_chunks(texts, _CHUNK_BYTES):
                    counts = np.zeros(hi - lo, np.int64)
                    out = np.zeros(0, np.int32)
                    if len(raw):
                        data, starts, stops, firsts = _word_spans(raw, offsets, joined)
                        hashes = units.word_hashes(data, starts, stops).view(np.int64)
                        values, inverse = np.unique(hashes, return_inverse=True)
                        at, hit = find(values, known)
                        begin, size = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
                        begin[hit], size[hit] = ends[at[hit]], ends[at[hit] + 1] - ends[at[hit]]
                        both = flat
                        if not hit.all():
                            extra = batch.column(2).slice(first + lo, hi - lo).flatten()
                            own = pa.table({"hash": extra.field("hash"), "ids": extra.field("ids")})
                            own_known, own_ends, own_flat = _pack(own, pieces.value)
                            own_at, found = find(values[~hit], own_known)
                            if not found.all():
                                raise ValueError("a word of a text is not among the encoded words")
                            own_ends = own_ends.astype(np.int64)
                            begin[~hit], size[~hit] = len(flat) + own_ends[own_at], own_ends[own_at + 1] - own_ends[own_at]
                            both = np.concatenate([flat, own_flat])
                        sizes = size[inverse]
                        stop = np.cumsum(sizes)
                        out = both[np.repeat(begin[inverse] - (stop - sizes), sizes) + np.arange(sizes.sum())].astype(np.int32)
                        per_word = np.concatenate([[0], stop])
                        counts = np.diff(per_word[firsts])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(out))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + lo, hi - lo), lists], names=["doc_id", "ids"])

    schema = "doc_id long, ids array<int>"
    if rare.isEmpty():
        return rows.select("doc_id", "text", F.lit(None).cast("array<struct<hash:long,ids:array<int>>>").alias("extra")).mapInArrow(assemble, schema)
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    lost = hashed.select("text_hash", "text").mapInArrow(missing, "text_hash long, hash long")
    extra = materialize(lost.join(rare, "hash").groupBy("text_hash").agg(F.collect_set(F.struct("hash", "ids")).alias("extra")))
    packed = hashed.select("doc_id", "text_hash", "text").mapInArrow(pack, "doc_id long, text_hash long, packed binary")
    return packed.join(extra, "text_hash", "left").select("doc_id", "packed", "extra").mapInArrow(assemble, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with ``text``: the text of its column ``ids``; null ids give null, no ids the empty text.

    Control pieces give nothing, byte pieces are joined before they are read as UTF-8, and the
    space that encoding put in front is taken away.
    """
    table = [b"" if i in vocabulary.special else p.replace(SPACE, " ").encode() for i, p in enumerate(vocabulary.pieces)]
    for value, i in vocabulary.bytes.items():
        table[i] = bytes([value])
    shared = encoded.sparkSession.sparkContext.broadcast(table)  # bounded by the vocabulary file

    def run(batches):
        table = np.array(shared.value, object)
        for batch in batches:
            texts = []
            for ids in batch.column(0):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                raw = b"".join(table[ids.values.to_numpy()].tolist())
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    kept = encoded.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.select("ids", *[F.col(f"`{c}`") for c in kept.columns]).mapInArrow(run, f"{fields}, text string")
