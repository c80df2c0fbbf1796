"""Shards: gapless, even, matching the mixture; repeated rows, odd tables, files read back."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from meterwright.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, shard string, slot double, nth int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, f"o{k}", 0.5, 3) for k, (d, t, s) in enumerate(rows)], DOCS)


def plain(rows, shards):
    """The order, worked out one row at a time."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    draw = lambda d, t: int(md5(f"{sharding.SEED}:{'null' if d is None else d}:{md5(t or '')}")[:15], 16)
    phase = lambda s: int(md5(f"{sharding.SEED}:{chr(0) + 'null' if s is None else s}")[:8], 16) / 2**32
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((draw(d, t), d is not None, d or 0, t or ""))
    order = []
    for s, own in by.items():
        for rank, (_, known, d, t) in enumerate(sorted(own)):
            order.append(((rank + phase(s)) / len(own), s is None, s or "", rank, d if known else None, t))
    order.sort(key=lambda r: r[:4])
    n, slots, out = len(order), Counter(), []
    for place, row in enumerate(order):
        shard = place * shards // n
        out.append((row[4], len(row[5].encode()) + 8, zlib.crc32(row[5].encode()), shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


def found(docs, shards=24):
    rows = sharding.interleaved(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    sources = ["a"] * 500 + ["b"] * 130 + ["c"] * 60 + [f"host{k}" for k in range(90)] + [None] * 70
    out = [(k, " ".join(rng.choice("xyzé") for _ in range(rng.randrange(40))), s) for k, s in enumerate(sources)]
    out += [(3, None, "a"), (None, None, None), (None, "t", "a"), (None, "t", "a"), (8, "", "b")]
    out += [(9000, "copied", "a")] * 250  # repeated rows
    return out


@pytest.mark.parametrize("cell, run", [(50_000, 10_000), (40, 7)])
def test_shards(spark, rows, monkeypatch, cell, run):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    monkeypatch.setattr(sharding, "RUN", run)
    docs = table(spark, rows)
    assert found(docs) == plain(rows, 24)
    got = sharding.interleaved(docs).collect()
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # every shard matches the mixture
    of = Counter(r.source for r in got)
    for source in ("a", "b", "c", None):
        for shard in range(24):
            here = sum(r.source == source and r.shard == shard for r in got)
            assert abs(here - of[source] / 24) <= 3, (source, shard)
    # sources of one row are not all in one shard
    assert len({r.shard for r in got if (r.source or "").startswith("host")}) >= 20


def test_shards_of_odd_tables(spark):
    assert found(table(spark, [])) == []
    few = [(1, "x", "a"), (2, None, None), (2, None, None)]
    assert found(table(spark, few)) == plain(few, 24)
    same = [(5, "y", None)] * 100
    assert found(table(spark, same), 7) == plain(same, 7)
    assert found(table(spark, [(1, "w" * 2_000_000, "a")])) == plain([(1, "w" * 2_000_000, "a")], 24)


def test_order_is_random_but_fixed(spark, rows):
    docs = table(spark, rows)
    first = found(docs)
    assert first == found(docs.repartition(7))
    other = sharding.interleaved(docs, 24, "another seed").select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted((tuple(r) for r in other), key=str) != first


def test_written_shards(spark, rows, tmp_path):
    docs = table(spark, rows)
    path = f"file://{tmp_path}/shards"
    manifest = {r["shard"]: r for r in sharding.write_shards(docs, path, 6).collect()}
    index = defaultdict(dict)
    for r in sharding.interleaved(docs, 6).collect():
        index[r.shard][r.slot] = (r.doc_id, r.size, r.source)
    back = []
    for shard in range(6):
        held = sharding.read_shard(spark, path, shard, docs.columns).collect()
        assert [r["slot_"] for r in held] == list(range(len(held)))
        assert [(r.doc_id, len((r.text or "").encode()) + 8, r.source) for r in held] == [index[shard][k] for k in range(len(held))]
        assert manifest[shard]["rows"] == len(held) and manifest[shard]["bytes"] == sum(len((r.text or "").encode()) + 8 for r in held)
        back += [tuple(r[c] for c in docs.columns) for r in held]
    assert sorted(back, key=str) == sorted((tuple(r) for r in docs.collect()), key=str)
