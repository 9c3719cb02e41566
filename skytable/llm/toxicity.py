"""Toxicity by non-negative learning from confirmed toxic examples and unlabelled text.

A member of the ensemble sees positives P (confirmed toxic) and a share of unlabelled texts U, and
minimises pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)]) with the class prior pi and the
logistic loss l. Where the second term falls below zero its gradient is reversed, so the
estimate cannot be driven below zero by fitting the positives. Members are trained with numpy,
each in a Spark task of its own; a score is the mean of the members' probabilities.

Features are the distinct words of a text (letters and digits, lower case) and the first five, six
and seven characters of longer words. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import bounded_batches

# The classifiers are fitted on a bounded sample: at most so many positives and so many
# unlabelled texts per member, taken in the order of a hash of the id.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
MEMBERS = 3
# A feature must occur in so many texts of a member's sample; at most so many are kept.
LEAST_TEXTS = 4
MAX_FEATURES = 20_000
# Standard errors by which a feature's rates must differ.
LEAST_GAP = 4.5
BUCKETS = 1 << 22
PREFIXES = (5, 6, 7)
_WORD = re.compile(r"\w+")
_CACHE = 100_000


def word_features(word: str) -> tuple[int, ...]:
    names = [f"w{word}"] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names)


def _features(text: str | None, cache: dict) -> set[int]:
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        known = cache.get(word)
        if known is None:
            if len(cache) > _CACHE:
                cache.clear()
            known = cache[word] = word_features(word)
        found.update(known)
    return found


def fit(features: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) of one linear classifier under the non-negative risk."""
    if positive.all() or not positive.any():
        # One side is missing from the sample: only the prior is known.
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    sizes = np.array([len(f) for f in features])
    flat = np.concatenate([*features, np.zeros(0, np.int32)]).astype(np.int32)
    # Counts by feature number need no sorting; there are at most BUCKETS of them, and more than half are zero.
    texts = np.bincount(flat)
    in_positive = np.bincount(flat[np.repeat(positive, sizes)], minlength=len(texts))
    names = np.flatnonzero(texts)
    texts, in_positive = texts[names], in_positive[names].astype(float)
    n_pos, n_un = max(1, positive.sum()), max(1, (~positive).sum())
    # Only features whose rates in positives and in unlabelled texts differ beyond chance.
    both = texts / (n_pos + n_un)
    gap = np.abs(in_positive / n_pos - (texts - in_positive) / n_un) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_pos + 1 / n_un))
    chosen = np.flatnonzero((texts >= LEAST_TEXTS) & (gap >= LEAST_GAP))
    chosen = np.sort(chosen[np.argsort(-gap[chosen], kind="stable")[:MAX_FEATURES]])
    place = np.full(int(names[-1]) + 1 if len(names) else 1, -1, np.int32)
    place[names[chosen]] = np.arange(len(chosen), dtype=np.int32)
    column = place[flat]
    kept = column >= 0
    row, column = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept], column[kept]
    del flat, place, kept
    # Adaptive steps; the bias is one more weight and starts at the prior's log odds.
    weights = np.zeros(len(chosen) + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        f = np.bincount(row, weights=weights[column], minlength=len(sizes)) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative = np.logaddexp(0, f)
        rest = negative[~positive].mean() - prior * negative[positive].mean()
        g = np.where(positive, -prior * (1 - p) / n_pos, 0.0)
        g_rest = np.where(positive, -prior * p / n_pos, p / n_un)
        g = g + g_rest if rest >= 0 else -g_rest
        slope = np.append(np.bincount(column, weights=g[row], minlength=len(chosen)), g.sum())
        slope[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return names[chosen], weights[:-1], float(weights[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The ensemble as rows (member, feature, weight); feature -1 is the bias.

    ``usable`` is a condition on doc_id: only documents that meet it are learnt from, their
    labels as their texts. The class prior is the toxic share of the usable labelled documents.
    The rows are at most ``MEMBERS * (MAX_FEATURES + 1)``.
    """
    marks = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    prior = marks.agg(F.avg("toxic")).first()[0]
    if not prior or prior >= 1:
        # Nothing confirmed, or nothing else: the score is the prior itself.
        bias = -30.0 if not prior else 30.0
        return docs.sparkSession.createDataFrame([(0, -1, bias)], "member int, feature long, weight double")
    turn = F.xxhash64("doc_id", F.lit("sample"))
    share = F.pmod(F.xxhash64("doc_id", F.lit("member")), F.lit(MEMBERS)).cast("int")
    positives = marks.filter("toxic = 1").select("doc_id").orderBy(turn, "doc_id").limit(MAX_POSITIVE)
    others = docs.filter(usable & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    others = others.orderBy(turn, "doc_id").limit(MEMBERS * MAX_UNLABELLED)
    # Both samples are bounded by the limits above, so they may be broadcast.
    sample = positives.select("doc_id", F.lit(True).alias("positive"), F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)])).alias("member")).unionByName(
        others.select("doc_id", F.lit(False).alias("positive"), share.alias("member"))
    )
    rows = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def extract(batches):
        cache: dict = {}
        for batch in batches:
            sets = [sorted(_features(t, cache)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.list_(pa.int32()))], names=["member", "positive", "doc_id", "features"])

    found = rows.select("member", "positive", "doc_id", "text").mapInArrow(extract, "member int, positive boolean, doc_id long, features array<int>")

    def learn(key, table):
        table = table.sort_by([("positive", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        names, weights, bias = fit([f.values.to_numpy() for f in table.column("features")], table.column("positive").to_numpy(zero_copy_only=False), prior)
        return pa.table({
            "member": pa.array(np.full(len(names) + 1, key[0].as_py(), np.int32)),
            "feature": pa.array(np.append(names, -1).astype(np.int64)),
            "weight": pa.array(np.append(weights, bias)),
        })

    return found.groupBy("member").applyInArrow(learn, "member int, feature long, weight double")


def _scorer(model: DataFrame):
    """A function from texts to scores that tasks can run."""
    rows = model.toArrow()
    members = sorted(set(rows.column("member").to_pylist()))
    weights: dict[int, np.ndarray] = {}
    # Without members (nothing to learn from) nothing is toxic.
    bias = np.zeros(len(members)) if members else np.full(1, -30.0)
    for m, f, w in zip(*(rows.column(k).to_pylist() for k in ("member", "feature", "weight"))):
        if f < 0:
            bias[members.index(m)] = w
        else:
            weights.setdefault(f, np.zeros(len(members)))[members.index(m)] = w
    names = np.array(sorted(weights), np.int64)
    table = np.array([weights[f] for f in names]) if len(names) else np.zeros((0, len(bias)))
    shared = model.sparkSession.sparkContext.broadcast((names, table, bias))

    def start():
        names, table, bias = shared.value
        number = {f: i for i, f in enumerate(names.tolist())}
        cache: dict[str, tuple[int, ...]] = {}

        def scores(texts) -> np.ndarray:
            out = []
            for text in texts:
                found: set[int] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    known = cache.get(word)
                    if known is None:
                        if len(cache) > _CACHE:
                            cache.clear()
                        known = cache[word] = tuple(number[f] for f in word_features(word) if f in number)
                    found.update(known)
                logits = bias + table[sorted(found)].sum(axis=0)
                out.append(float((1 / (1 + np.exp(-np.clip(logits, -30, 30)))).mean()))
            return np.array(out, float)

        return scores

    return start


def keep_clean(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below one half.

    Only texts go to Python and only scores come back. A null or empty text scores as a text without words; repeated rows
    stay or go together; an empty table stays empty. Other columns may have any name.
    """
    start = _scorer(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = start()
        for batch in texts:
            yield pa.array(scores(batch.to_pylist()), pa.float64())

    return bounded_batches(docs).filter(F.arrow_udf(run, "double")(F.col("text").cast("string")) < 0.5)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``: doc_id and text are read, other columns are not used.

    The score of a null or empty text is that of a text without words (the members' biases). Very
    long texts are scored whole. Repeated rows get one score each, and an empty table gives no rows.
    """
    start = _scorer(model)

    def run(batches):
        score_of = start()
        for batch in batches:
            scores = score_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int"
    )
