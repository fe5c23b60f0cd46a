"""Conversation trie against a trie grown turn by turn."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from dossier.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def grown(lists):
    """Nodes of {conv_id: [(role, text)]} by walking every prefix."""
    members = {}
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(lists[c]) == len(p))))
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(rows):
    lists = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        lists.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in lists.items():
        h, source = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        out[c] = lists.get(source, [])[:h] + own[h:]
    return out


def rows(seed, convs=200, deep=False):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-40, 4 * convs), convs):
        n = rng.choice([1, 2, 3, 9, 12]) + (rng.choice([0, 40, 90]) if deep else 0)
        out += [(c, None if t == 0 and c % 3 else t, rng.choice(["u", "a", None]) if rng.random() < 0.1 else "u", rng.choice(["hé", "yes", "", None]) if rng.random() < 0.2 else "same", "x") for t in range(n)]
    out += [(c, t, "u", f"copy {t}", "x") for c in range(5000, 5300) for t in range(3)] + [(None, 1, "u", "lost", "x")]
    return rng.sample(out, len(out))


@pytest.mark.parametrize("shard", [60, 300, None])
@pytest.mark.parametrize("deep", [False, True])
def test_nodes_equal_a_grown_trie(spark, shard, deep, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    given = rows(1 + deep, deep=deep)
    got = prefix_trie.conversation_trie(spark.createDataFrame(given, SCHEMA), shard).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == grown(rebuilt(given))


def test_plain_lists_and_turnless_conversations(spark):
    lists = {1: [], 2: [], 5: [("u", "a")], 9: [("u", "a"), ("", "b")], 11: [("u", "a"), ("", "b")]}
    ids = lambda turns: [(hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1])) for t in turns]
    df = spark.createDataFrame([(c, ids(t)) for c, t in lists.items()], "conv_id long, turns array<struct<id binary, n int>>")
    for shard in (1, 2, 100):
        assert {tuple(r) for r in prefix_trie.trie(df, shard).collect()} == grown(lists)
    alone = df.where("conv_id < 3")
    assert [tuple(r)[:7] for r in prefix_trie.trie(alone, 1).collect()] == [(1, 0, None, 2, 0, 1, 0)]


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_rows_are_sorted_band_by_band():
    rng = np.random.default_rng(2)
    for _ in range(40):
        size = rng.integers(0, 50, 60)
        offs = np.r_[0, np.cumsum(size)]
        turn = rng.integers(1, 3, offs[-1]).astype(np.int32) if rng.random() < 0.5 else np.ones(offs[-1], np.int32)
        conv = rng.permutation(60)
        lists = [tuple(turn[a:b].tolist()) for a, b in zip(offs, offs[1:])]
        order, shared = prefix_trie.sorted_rows(conv, offs, turn, band=4)
        assert order.tolist() == sorted(range(60), key=lambda r: (lists[r], conv[r]))
        for i in range(1, 60):
            a, b = lists[order[i - 1]], lists[order[i]]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[i] == same
