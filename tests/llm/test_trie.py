"""The prefix trie against brute force: deep bands, shared openings, nulls, ties, repeated rows, empty tables."""

import hashlib
import random
import zlib

import pytest

from meterwright.llm import trie

ROWS = "conv_id long, turn long, role string, text string, node string, depth int, paths string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))
    for own in turns.values():
        digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2])))
    rebuilt = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        rebuilt[conv] = tuple((r, t) for _, r, t in turns.get(first, [])[:h] + own[h:])
    members = {}
    for conv, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(conv)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    saved, leaves = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        kids = children.get(seq, [])
        own = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        saved[seq] = own + sum(saved[k] for k in kids)
        leaves[seq] = sum(leaves[k] for k in kids) if kids else 1
    out = []
    for seq, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(seq))
        parent = min(members[seq[:-1]]) if seq else None
        out.append((min(convs), len(seq), parent, len(convs), len(children.get(seq, [])), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROWS)
    return sorted((tuple(r) for r in trie.prefix_trie(table).select(*COLUMNS).collect()), key=str)


def conversation(rng, conv, n, say=3):
    return [(conv, k, rng.choice(["user", "assistant"]), "é" * rng.randrange(say)) for k in range(n)]


def test_trie_of_small_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in range(-12, 60) for r in conversation(rng, c, rng.randrange(0, 12)) if c % 5 or c % 3]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (10, None, "user", "first"), (10, 0, None, None), (10, 0, None, None), (10, 1, "user", ""),  # null turn first, repeated rows
        (11, 0, "a", "b"), (11, 0, "ab", ""), (11, 0, "", "ab"),  # ties; role and text do not run together
        (None, 0, "user", "left out"), (7, 3, "user", "short: gone with its opening"), (2**62, 0, "user", "x"), (-(2**62), 0, "user", "x"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows * 2) == brute(rows * 2)


def test_trie_over_several_bands(spark):
    """More depths than two bands of bands have; branches at depths on, before and after the bands' roots."""
    rng = random.Random(2)
    trunk = [(0, k, "user", f"{k}") for k in range(600)]
    rows = list(trunk)
    for conv, cut in enumerate([1, 7, 8, 9, 15, 63, 64, 65, 128, 511, 512, 513, 600], start=1):
        rows += [(5 * conv, k, r, t) for _, k, r, t in trunk[:cut]] + [(5 * conv, 1000 + k, "user", "tail" * rng.randrange(1, 3)) for k in range(rng.randrange(1, 80))]
    assert trie.BAND**3 < 600
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [40, 65_536])
def test_many_members_of_one_node(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = [(c, k, "user", "same") for c in range(0, 4000, 5) for k in range(2)] + [(c, 0, "user", f"{c}") for c in range(1, 400, 5)]
    assert found(spark, rows) == brute(rows)


def test_trie_of_an_empty_table(spark):
    assert found(spark, []) == []


def test_no_node_explodes_beyond_its_band(spark):
    """What a node carries, which is what it explodes to, is bounded on every level."""
    table = spark.createDataFrame([(0, k, "user", f"{k}", "x", 1, "y") for k in range(700)], ROWS)
    for row in trie.walk(table).collect():
        assert all(len(p) <= trie.BAND for p in row.paths)
        assert len(row.paths) == (0 if row.depth == 0 else 1 + sum(row.depth % trie.BAND**k == 0 for k in (1, 2, 3)))


def test_band_roots_are_needed(spark, monkeypatch):
    """Without the totals that go across bands the sums end at the bands' roots."""
    rows = [(0, k, "user", "x") for k in range(30)] + [(5, k, "user", "x") for k in range(30)]
    assert found(spark, rows) == brute(rows)
    real = trie._rolled_up
    monkeypatch.setattr(trie, "_rolled_up", lambda nodes, deepest, sums, level=0: real(nodes, 0, sums, level))
    assert found(spark, rows) != brute(rows)
