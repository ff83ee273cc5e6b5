"""The prefix trie against a plain trie of the rebuilt conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pitwall.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, p string, shared string"


def plain(rows):
    """Rows of the result as a set of tuples; turns of a conversation have distinct numbers."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(first, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = set()
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in held if rebuilt[c] == node)
        out.add((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held),
            sum(len(n) == len(node) + 1 for n in below),
            sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "d", "p", "s") for r in rows], TURNS).repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def some(seed, n, words):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(-150, 450), n):
        size = pick.choice([1, 2, 3, 5, 8, 12])
        turns = [None, *range(size - 1)] if pick.random() < 0.1 else pick.sample(range(40), size)
        for turn in turns:
            rows.append((c, turn, pick.choice(["user", "assistant", None]), pick.choice(words)))
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, ["a", "bb", None]), (2, ["same é🙂"]), (3, [f"text {i}" for i in range(30)])])
def test_trie_equals_the_plain_one(spark, seed, words):
    rows = some(seed, 60, words)
    assert trie(spark, rows) == plain(rows)


def test_trie_with_a_crowded_sketch_and_long_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST", 1 << 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "JOINED", 8)
    rows = some(4, 50, ["a", "b"]) + [(1000 + c, t, "user", f"t{t % 3}") for c in (0, 1, 100, 103) for t in range(30)]
    assert trie(spark, rows) == plain(rows)


def test_a_large_group_of_copies_has_one_path(spark):
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    got = trie(spark, rows)
    assert got == plain(rows)
    assert {(r[1], r[3]) for r in got} == {(d, 400) for d in range(4)}


def test_crowded_cells_only_cost_work(spark, monkeypatch):
    """A sketch that takes every prefix for a shared one gives the same trie."""
    rows = some(5, 40, [f"t{i}" for i in range(9)])
    real = prefix_trie._sketch
    monkeypatch.setattr(prefix_trie, "_sketch", lambda names, cells: [x | 255 for x in real(names, cells)])
    assert trie(spark, rows) == plain(rows)


def test_trie_of_odd_rows(spark):
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 1, "user", "x")]) == set()
    # Conversation 1 skips its one turn and finds no conversation 0: a member of the root alone.
    skips = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6][0]
    rows = [(skips, 0, "user", "x"), (None, 0, "user", "y")]
    assert trie(spark, rows) == plain(rows) == {(skips, 0, None, 1, 0, 1, 0, hashlib.sha256(str(skips).encode()).hexdigest())}
    long = [(0, t, "user", "x" * 100_000 if t == 1 else None) for t in range(3)]
    assert trie(spark, long) == plain(long)
    # A repeated row is a turn of its own; equal turn numbers have one order whatever the partitions.
    twice = [(0, 1, "user", "x"), (0, 1, "user", "x"), (0, 2, "b", "y"), (0, 2, "a", "z")]
    got = trie(spark, twice)
    assert got == trie(spark, twice[::-1])
    assert sorted(r[1] for r in got) == [0, 1, 2, 3, 4]
