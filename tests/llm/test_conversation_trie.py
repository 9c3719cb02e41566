"""The trie against a plain dictionary of prefixes, with small shards so that many nodes are shared."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skytable.llm import conversation_trie as t

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # Equal turn numbers go by role, then by the digest of role and text.
    digest = lambda r, x: hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (y[0], y[1], y[2], digest(y[2], y[3])))] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        paths[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = lambda x: sum(len(m) == len(x) + 1 and m[: len(x)] == x for m in below)
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids(node),
            sum(kids(m) == 0 for m in below), sum((len(members[m]) - 1) * words(m) for m in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def random_rows(n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 7])):
            rows.append((c - 10, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "a b", "c", "", None, "d\te\nf"])))
    rows += [(500 + c, turn, "user", "same turn") for c in range(40) for turn in range(4)]
    rows += [(1000, turn, "bot", f"turn {turn}") for turn in range(300)]
    rows += [rows[5], rows[5], (None, 1, "user", "nobody's"), (None, None, None, None), (7000, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns,text", [(20_000, 1 << 16), (25, 20)])
def test_equals_a_dictionary_of_prefixes(spark, monkeypatch, turns, text):
    monkeypatch.setattr(t, "SHARD_TURNS", turns)
    monkeypatch.setattr(t, "ID_TEXT_BYTES", text)
    rows = random_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, path string")
    assert sorted((tuple(r) for r in t.nodes(frame).collect()), key=repr) == brute(rows)


def test_without_rebuilding(spark, monkeypatch):
    monkeypatch.setattr(t, "SHARD_TURNS", 10)
    rows = random_rows(40, 4)[:200]
    assert sorted((tuple(r) for r in t.nodes(spark.createDataFrame(rows, SCHEMA), rebuild=False).collect()), key=repr) == brute(rows, False)


def test_no_rows(spark):
    assert t.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert t.nodes(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_double_array_walks():
    rng = random.Random(1)
    paths = sorted({tuple(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(400)})
    coded = [np.array(p, np.int64) for p in paths]
    trie = t.DoubleArray(coded, 50)
    states = {}
    for depth, (alive, state) in enumerate(trie.walk(coded)):
        for i, s in zip(alive, state):
            assert states.setdefault(int(s), paths[i][:depth]) == paths[i][:depth]
    assert len(states) == len({p[:d] for p in paths for d in range(len(p) + 1)}) == sum(map(len, trie.levels))
