"""A trie of conversations: what their first turns have in common, with aggregates for every node.

1. Each conversation becomes a path, the keys of its turns one after another (16 bytes of MD5 for role and text).
   Equal paths are counted by a hash aggregate, so copies of one conversation travel once.
2. The distinct paths are range partitioned in byte order. A range is a prefix shard: a node lies in two ranges only if it is
   on the path where one ends and the next begins, however frequent its prefix is. How many turns the first path of a
   range has in common with the last path before it says which nodes belong to an earlier range.
3. In a shard, turns get dense numbers and the paths are packed into a double array: the child of ``state`` by turn ``t`` stands
   at ``BASE[state] + t``, and ``CHECK`` there holds ``state``. Walks over the arrays count members, and sums run up from
   the leaves. Each node is counted as owned by one shard, so all aggregates of nodes that shards share can be added.
4. Shared nodes are merged by depth and the MD5 of their path with one aggregate; there are at most as many of them as
   turns on the first and last paths of the shards.

Turns of a conversation go by turn (null first), then role, then MD5 of role and text; repeated rows are repeated turns. A null role
or text is empty. Rows without a conv_id belong to no conversation and are left out. An empty table gives no nodes. Other
columns may have any name. Bound: the turn keys of one conversation (28 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytable.llm.common import BROADCAST_ROWS, bounded_batches
from skytable.operators.skew import salted_join
from skytable.session import materialize

# Turns of distinct paths in a shard, about.
SHARD_TURNS = 20_000
# Turns of another conversation that one may begin with, at most.
HEAD = 3
KEY_BYTES = 16
# Free places that are tried for a group of children before they go to the end of the arrays.
_TRIES = 32
# Text of ids that is handed on in one row on the way to a digest.
ID_TEXT_BYTES = 1 << 16

_NODES = "id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, spent long, saved long, ender long"


class DoubleArray:
    """Paths of turn numbers packed in BASE and CHECK; ``order`` lists the states level by level."""

    def __init__(self, paths: list[np.ndarray], turns: int):
        """``paths``: sorted, distinct; numbers from 0 to ``turns`` - 1."""
        size = turns + 2
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0  # the root's own place
        self._free = 1
        lengths = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = np.concatenate(paths) if len(paths) else np.zeros(0, np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        state = np.zeros(len(paths), np.int64)
        self.levels = [np.zeros(1, np.int64)]
        alive = np.flatnonzero(lengths > 0)
        depth = 0
        while len(alive):
            turn = flat[begins[alive] + depth]
            # Paths are sorted, so a state's children stand together and in order.
            new = np.ones(len(alive), bool)
            new[1:] = (state[alive[1:]] != state[alive[:-1]]) | (turn[1:] != turn[:-1])
            first = np.flatnonzero(new)
            owners, groups = state[alive[first]], turn[first]
            cuts = np.flatnonzero(np.diff(owners, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(owners))):
                self._place(int(owners[a]), groups[a:b])
            self.levels.append(self.base[owners] + groups)
            state[alive] = self.base[state[alive]] + turn
            depth += 1
            alive = alive[lengths[alive] > depth]
        self.end = state

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, state: int, children: np.ndarray) -> None:
        """Choose BASE so that all children fall on free places."""
        span, least = children - children[0], int(children[0])
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        at = self._free
        for _ in range(_TRIES):
            self._room(at + int(span[-1]) + 1)
            taken = self.check[at + span] >= 0
            if not taken.any():
                break
            at += 1
            while at < len(self.check) and self.check[at] >= 0:
                at += 1
        else:
            at = len(self.check)
            self._room(at + int(span[-1]) + 1)
        self.base[state] = at - least
        self.check[at + span] = state

    def walk(self, paths: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(paths that are alive, their state) at each depth, by BASE and CHECK alone."""
        state = np.zeros(len(paths), np.int64)
        alive, depth = np.arange(len(paths)), 0
        while len(alive):
            yield alive, state[alive]
            alive = alive[[len(paths[i]) > depth for i in alive]]
            turn = np.fromiter((paths[i][depth] for i in alive), np.int64, len(alive))
            to = self.base[state[alive]] + turn
            if (self.check[to] != state[alive]).any():
                raise AssertionError("a path left the trie")
            state[alive] = to
            depth += 1


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // KEY_BYTES
    x = np.frombuffer(a, f"V{KEY_BYTES}", n)
    y = np.frombuffer(b, f"V{KEY_BYTES}", n)
    return int(np.argmin(np.append(x == y, False)))


def _shard_nodes(paths: list[bytes], words: list[list[int]], n: np.ndarray, least: np.ndarray, before: int, after: int, extended: bool) -> pa.RecordBatch:
    """Nodes of one shard. ``before`` / ``after``: turns shared with the path before the first / after the last one.

    ``extended``: the path after the last one goes on from it, so that its end is no leaf.
    """
    keys = np.frombuffer(b"".join(paths), f"S{KEY_BYTES}") if any(paths) else np.zeros(0, f"S{KEY_BYTES}")
    raw = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, KEY_BYTES)
    distinct, number = np.unique(raw.view([("hi", ">u8"), ("lo", ">u8")]).reshape(-1), return_inverse=True) if len(raw) else (keys, np.zeros(0, np.int64))
    cuts = np.cumsum([len(p) // KEY_BYTES for p in paths])[:-1]
    coded = np.split(number.astype(np.int64), cuts)
    trie = DoubleArray(coded, len(distinct))
    size = len(trie.check)
    members, smallest = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    weight, sample = np.zeros(size, np.int64), np.zeros(size, np.int64)
    ender, ends = np.zeros(size, np.int64), np.zeros(size, bool)
    shared, known, depth_of = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.int64)
    for depth, (alive, state) in enumerate(trie.walk(coded)):
        np.add.at(members, state, n[alive])
        np.minimum.at(smallest, state, least[alive])
        sample[state[::-1]] = alive[::-1]
        if depth:
            weight[state] = np.fromiter((words[i][depth - 1] for i in alive), np.int64, len(alive))
        depth_of[state] = depth
        if alive[0] == 0 and depth <= before:
            shared[state[0]] = known[state[0]] = True
        if alive[-1] == len(paths) - 1 and depth <= after:
            shared[state[-1]] = True
    shared[0] = True
    ends[trie.end], ender[trie.end] = True, least
    children, leaves, spent, saved = (np.zeros(size, np.int64) for _ in range(4))
    for level in trie.levels[:0:-1]:
        np.add.at(children, trie.check[level], (~known[level]).astype(np.int64))
    every = np.concatenate(trie.levels)
    bare = np.zeros(size, bool)
    bare[every] = True
    for level in trie.levels[1:]:
        bare[trie.check[level]] = False
    if extended:
        bare[trie.end[-1]] = False
    for level in trie.levels[::-1]:
        leaves[level] += bare[level] & ~known[level]
        spent[level] += members[level] * weight[level]
        saved[level] += np.where(known[level], 0, weight[level])
        if level[0] != 0:
            for total in (leaves, spent, saved):
                np.add.at(total, trie.check[level], total[level])
    up = np.where(every == 0, -1, trie.check[every])
    shared_up = (up >= 0) & shared[np.maximum(up, 0)]

    def prefix(state: int) -> bytes:
        return hashlib.md5(paths[sample[state]][: depth_of[state] * KEY_BYTES]).digest()

    names = {int(s): prefix(s) for s in every[shared[every]].tolist()}
    columns = [
        pa.array([names.get(s) if shared[s] else None for s in every.tolist()], pa.binary()),
        pa.array([names[u] if k else None for u, k in zip(up.tolist(), shared_up.tolist())], pa.binary()),
        pa.array(depth_of[every]),
        pa.array(smallest[every]),
        pa.array(smallest[np.maximum(up, 0)], mask=(up < 0) | shared_up),
        pa.array(members[every]),
        pa.array(children[every]),
        pa.array(leaves[every]),
        pa.array(spent[every]),
        pa.array(saved[every]),
        pa.array(ender[every], mask=~ends[every]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODES.split(", ")])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).sort_by("path")
    get = lambda name: table[name].combine_chunks()
    n, least = (get(c).to_numpy() for c in ("n", "least"))
    first = {c: table[c][0].as_py() for c in ("before", "after", "extended")}
    yield _shard_nodes(get("path").to_pylist(), get("words").to_pylist(), n, least, **first)


def paths_of(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """(conv_id, path, words): the turn keys and the words of each turn, in order.

    With ``rebuild``, conversation c begins with the first h turns of conversation c - c % 20, h being crc32(c) % 4, in place of its own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = bounded_batches(turns).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("t"),
    )
    own = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    if rebuild:
        own = materialize(own.select("conv_id", F.transform("own", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("own")))
        base = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.slice("own", 1, HEAD).alias("_front"))
        h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
        joined = own.withColumn("_base", F.expr("conv_id - conv_id % 20")).join(base, "_base", "left")
        front = F.when(h > 0, F.slice(F.coalesce("_front", F.slice("own", 1, 0)), 1, F.greatest(h, F.lit(1)))).otherwise(F.slice("own", 1, 0))
        rest = F.when(F.size("own") > h, F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).otherwise(F.slice("own", 1, 0))
        own = joined.select("conv_id", F.concat(front, rest).alias("own"))
    path = F.unhex(F.array_join(F.transform("own", lambda t: F.hex(t["key"])), ""))
    return own.select("conv_id", path.alias("path"), F.transform("own", lambda t: t["words"]).alias("words"))


def _digests(members: DataFrame) -> DataFrame:
    """(ender, ends_sha256) of (ender, conv_id): the digest of the ids in order, joined by commas.

    Ids become pieces of text in ranges of any key, so the task that must see a key whole reads few rows of text.
    """

    def pieces(batches):
        held, key, first, size = [], None, None, 0
        for batch in batches:
            for ender, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (ender != key or size >= ID_TEXT_BYTES):
                    yield pa.RecordBatch.from_pydict({"ender": [key], "first": [first], "ids": [",".join(held)]})
                    held, size = [], 0
                if not held:
                    key, first = ender, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield pa.RecordBatch.from_pydict({"ender": [key], "first": [first], "ids": [",".join(held)]})

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            for ender, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is not None and ender == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    yield pa.RecordBatch.from_pydict({"ender": [key], "ends_sha256": [sha.hexdigest()]})
                key, sha = ender, hashlib.sha256(ids.encode())
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"ender": [key], "ends_sha256": [sha.hexdigest()]})

    text = members.select("ender", "conv_id").repartitionByRange("ender", "conv_id").sortWithinPartitions("ender", "conv_id").mapInArrow(pieces, "ender long, first long, ids string")
    return text.repartition("ender").sortWithinPartitions("ender", "first").mapInArrow(digest, "ender long, ends_sha256 string")


def nodes(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    A node stands for all conversations that begin with the same ``depth`` turns; ``conv_id`` is the least of them, and with
    ``depth`` names the node. ``saved_tokens`` are the words that a store of the subtree's turns need not hold twice. The digest is
    over the ids of conversations that end at the node.
    """
    convs = materialize(paths_of(turns, rebuild))
    distinct = convs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"))
    known = materialize(distinct)
    total = known.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranged = materialize(known.repartitionByRange(int(1 + total // SHARD_TURNS), "path").withColumn("shard", F.spark_partition_id()))
    # One row for each shard; the window over them holds two paths of each.
    order = Window.orderBy("shard")
    borders = ranged.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")).withColumns(
        {"prior": F.lag("high").over(order), "next": F.lead("low").over(order)}
    )

    @F.udf("struct<before:int,after:int,extended:boolean>")
    def border(low, high, prior, following):
        low, high = bytes(low), bytes(high)
        return (
            -1 if prior is None else _common(low, bytes(prior)),
            -1 if following is None else _common(high, bytes(following)),
            following is not None and bytes(following).startswith(high),
        )

    borders = borders.select("shard", border("low", "high", "prior", "next").alias("b")).select("shard", "b.*")
    built = materialize(ranged.join(F.broadcast(borders), "shard").groupBy("shard").applyInArrow(_build, _NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spent", "saved")]
    upper = materialize(
        built.filter("id IS NOT NULL").groupBy("id", "depth").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums, F.max("ender").alias("ender"))
    )
    above = upper.select(F.col("id").alias("parent"), F.col("depth").alias("_depth"), F.col("conv_id").alias("_above"))
    count = upper.count()
    if count <= BROADCAST_ROWS:
        above = F.broadcast(above)
    below = built.filter("id IS NULL").drop("id")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "spent", "saved", "ender"]
    inside = below.filter("parent IS NULL").select(*result)
    edge = (
        below.filter("parent IS NOT NULL").select("parent", (F.col("depth") - 1).alias("_depth"), *[c for c in result if c != "parent_conv_id"])
        .union(upper.select("parent", (F.col("depth") - 1).alias("_depth"), *[c for c in result if c != "parent_conv_id"]))
    )
    joined = edge.join(above, ["parent", "_depth"], "left") if count <= BROADCAST_ROWS else salted_join(edge, above, ["parent", "_depth"], ["conv_id"], "left")
    whole = inside.union(joined.withColumn("parent_conv_id", F.col("_above")).select(*result))

    many = known.filter("n > 1").select("path", F.col("least").alias("ender"))
    digests = _digests(salted_join(convs.select("path", "conv_id"), many, ["path"], ["conv_id"]).select("ender", "conv_id"))
    named = whole.join(digests, "ender", "left")
    return named.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("spent") - F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.coalesce(F.col("ender").cast("string"), F.lit("")), 256)).alias("ends_sha256"),
    )
