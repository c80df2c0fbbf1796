"""Blocks bounded by their shingles: the links stay, and long near copies do not meet in one block."""

import random

import numpy as np
import pytest

from meterwright.llm import jaccard


def words(rng, n, size):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def brute(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tokens, columns", [(700, 50), (3_000, 65_536), (4_000_000, 50)])
def test_blocks_by_shingles(spark, monkeypatch, tokens, columns):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = random.Random(tokens)
    texts = family(rng, words(rng, 300, 5000), 40, 3) + family(rng, words(rng, 60, 500), 30, 1) + [" ".join(words(rng, 40, 300)) for _ in range(40)] + [" ".join(words(rng, 900, 9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(df).collect()}
    assert got == brute(texts)


def test_no_block_is_larger_than_its_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 2_000)
    seen = []
    rows = spark.createDataFrame([(k, 7, 400) for k in range(100)] + [(1000 + k, 8, 10) for k in range(300)], "doc_id long, grp long, n long")
    for r in jaccard._salted(rows, 128).groupBy("grp", "salt").agg({"n": "sum", "doc_id": "count"}).collect():
        seen.append((r["grp"], r["sum(n)"], r["count(doc_id)"]))
    assert sum(1 for g, _, _ in seen if g == 7) >= 12 and max(n for _, n, _ in seen) <= 3 * 2_000 and max(c for _, _, c in seen) <= 2 * 128


def test_slices_of_a_matrix_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2000, n).astype(np.uint64)) for n in (1, 40, 900, 1500)]
    union = np.unique(np.concatenate(sets))
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for columns in (1, 7, 333, 10_000):
        monkeypatch.setattr(jaccard, "COLUMNS", columns)
        assert jaccard._shared(sets, sets, union).tolist() == want
        assert jaccard._shared(sets[:2], sets[1:], union).tolist() == [row[1:] for row in want[:2]]
    assert [jaccard._held(s, union[::2]) for s in sets] == [len(np.intersect1d(s, union[::2])) for s in sets] and jaccard._held(sets[0], union[:0]) == 0


def test_near_copies_of_a_very_long_text(spark):
    rng = random.Random(3)
    base = words(rng, 400_000, 10**6)
    rows = [(k, t) for k, t in enumerate(family(rng, base, 12, 50))] + [(100, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.join_similar(df).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 100: 100}
