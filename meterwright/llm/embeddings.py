"""Embedding near-dedup by NN-descent.

1. Vectors are scaled to length one, and equal ones go on as one counted
   vector. One tree of sign codes (random hyperplanes) deals them into blocks,
   and each vector takes its best neighbours of its block as its first list. That
   brings few of the links: two vectors at the threshold seldom share a block of a large table.
2. NN-descent finds the others: around every vector its neighbours, and those that hold it as a
   neighbour, are compared with each other; what beats the end of a list
   enters it. A list that is full of links is enlarged. A round goes only to
   vectors around which something is new, as the others have been compared, and
   the rounds go on until one brings no new link.
   Lists are bounded, so a group can fill its members' lists. Every block that
   is compared therefore also gives ties: edges that hold the classes of all
   its links together, at most one per member, whether or not the links find
   room in a list. Links and ties make candidate components.
3. A vector with a single partner may have no neighbour that leads to it. A forest of fresh trees, as many as it takes
   to bring an isolated pair at the threshold together with a chance of 1 - ``MISS``, looks at the components from
   outside: where a block has a link between two of them, the pair becomes a suggestion. A suggestion is no result: it
   is a new neighbour from which NN-descent goes on, until a forest has none.
4. Within a component all members are compared block by block in double
   precision: this gives every vector's exact number of links there, and keeps
   threshold edges only.
5. An audit takes two bounded samples, of all vectors and of those with few
   links, counts their links against all rows, and compares with what was
   found: in all, and for the mean vector of each sample. Below the target the
   search goes on with a new forest and longer lists, and when the restarts are
   used up all vectors are compared block by block.

Blocks are bounded: a bucket, a hub or a component with more rows is cut by
hash, and parts of one component meet pair by pair, so a third of all rows in
one bucket is dealt over many tasks. Link counts are summed, never listed.

Defined results: a vector that is null, empty, zero, or holds null, NaN or
infinite components links with nothing; vectors of different length do not
link; rows that share a vec_id, or have none, are vectors of their own (a
component's id is the smallest vec_id in it); an empty table gives an empty
result; labels and other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_side
from ._graph import components
from .jaccard import _classes

THRESHOLD = 0.9
#: First length of the neighbour lists, least trees of the forest, vectors in a block, members compared at once.
NEIGHBOURS, TREES, BLOCK, PAIR_BLOCK = 8, 12, 128, 512
#: Chance that one forest misses an isolated pair.
MISS = 0.05
#: Most rounds of one descent (later forests and the audit look after what they leave), and searches.
ROUNDS, RESTARTS = 20, 3
#: Vectors of each sample of the audit, and the share of their links that has to be found.
AUDIT, TARGET = 1024, 0.97
SEED = 11
#: Slack of the single-precision search; the last step compares in double precision.
SLACK = 1e-4

#: Equal vectors from which on their result is sent to all tasks.
MANY_COPIES = 1000


def _units(batches):
    for batch in batches:
        ids, nodes, units, dims, keys = [], [], [], [], []
        for vec_id, node, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v else np.zeros(0)
            most = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if most > 0:  # squares of the largest and the smallest components stay within range
                x = np.ldexp(x, -int(np.frexp(most)[1]))
            norm = np.linalg.norm(x) if most > 0 else 0.0
            ids.append(vec_id)
            nodes.append(node)
            units.append((x / norm).astype("<f8").tobytes() if norm > 0 else None)
            dims.append(len(x))
            # without a unit the row is known by its own number, so that no key is common to many
            keys.append(hashlib.blake2b(units[-1], digest_size=16).digest() if norm > 0 else node.to_bytes(8, "little"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(units, pa.binary()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary())], names=["vec_id", "node", "unit", "dim", "key"])


def unit_table(vectors: DataFrame) -> DataFrame:
    """vec_id, node (a number of the row), unit (doubles as bytes; null if the vector links with nothing), dim, key (digest of the unit)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("node"), F.col("embedding").cast("array<double>"))
    return materialize(rows.mapInArrow(_units, "vec_id long, node long, unit binary, dim int, key binary"), "units")


def distinct_units(table: DataFrame) -> DataFrame:
    """key, unit, dim, node, copies, first_id (the lowest vec_id): one row for each set of equal vectors."""
    rows = table.where("unit is not null").groupBy("key", "unit", "dim")
    return materialize(rows.agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")), "distinct-units")


def trees_needed(threshold: float, bits: int) -> int:
    """Trees of ``bits`` random hyperplanes in which a pair at the threshold shares a block at least once, but for a chance of ``MISS``."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return TREES if together > 1 - MISS else max(TREES, int(np.ceil(np.log(MISS) / np.log1p(-together))))


def _codes(trees: int, bits: int, seed: int):
    def work(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            for dim in set(batch.column("dim").to_pylist()):
                some = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed + dim).standard_normal((dim, trees * bits))
                x = np.frombuffer(b"".join(some.column("unit").to_pylist()), dtype="<f8").reshape(-1, dim)
                sign = (x @ planes[dim] > 0).reshape(len(x), trees, bits)
                code = (sign << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(x), trees), dtype=np.int64)
                units = pa.array([u.astype("<f4").tobytes() for u in x], pa.binary())
                rows = pa.array(np.repeat(np.arange(len(x)), trees))
                tree = np.tile(np.arange(trees), len(x)) + trees * dim
                yield pa.RecordBatch.from_arrays([some.column("node").take(rows), pa.array(tree, pa.int64()), pa.array(code.reshape(-1), pa.int64()), units.take(rows)], names=["node", "tree", "code", "unit"])

    return work


def _stack(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    flat = column.values if hasattr(column, "values") else column
    units = flat.field("unit").to_pylist()
    return flat.field("node").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(units), dtype=dtype).reshape(len(units), -1)


def _best(threshold: float, keep: int):
    """Blocks of (node, unit) -> (u, v, sim, tie): for each member its best others, and no more links than ``keep`` doubled twice;
    with ``tie`` the edges that hold the classes of all the block's links together."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                nodes, x = _stack(batch.column("members")[k], "<f4")
                if len(nodes) < 2:
                    continue
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                top = min(4 * keep, len(nodes) - 1)
                best = np.argpartition(-sims, top - 1, axis=1)[:, :top]
                value = np.take_along_axis(sims, best, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
                use = (np.arange(top)[None, :] < keep) | (value >= threshold)
                row, col = np.nonzero(use)
                label = _classes(sims >= threshold)
                far = np.flatnonzero(label != np.arange(len(label)))
                u, v = np.concatenate([nodes[row], nodes[far]]), np.concatenate([nodes[best[row, col]], nodes[label[far]]])
                sim = np.concatenate([value[row, col], sims[far, label[far]]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([u, v, sim, pa.array(np.arange(len(u)) >= len(row))], names=["u", "v", "sim", "tie"])

    return work


def _between(threshold: float):
    """Blocks of (node, unit, comp) -> (a, b): edges that hold the classes of all links between components together."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                nodes, x = _stack(batch.column("members")[k], "<f4")
                comp = batch.column("members")[k].values.field("comp").to_numpy(zero_copy_only=False)
                label = _classes((x @ x.T >= threshold) & (comp[:, None] != comp[None, :]))
                far = label != np.arange(len(label))
                yield pa.RecordBatch.from_arrays([nodes[far], nodes[label[far]]], names=["a", "b"])

    return work


def _lists(edges: DataFrame, threshold: float, keep: int) -> DataFrame:
    """(u, v, sim, tie) -> node, list (sim, v; best first): ``keep`` long, longer by doubling where it is full of links; ties (v)."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("tie").alias("tie"))
    tied = F.collect_list(F.when(F.col("tie"), F.col("v"))).alias("ties")
    best = best.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False).alias("all"), tied)
    links = F.size(F.filter("all", lambda e: e["sim"] >= threshold))
    length = F.when(links < keep, keep).when(links < 2 * keep, 2 * keep).otherwise(4 * keep)
    return best.select(F.col("u").alias("node"), F.slice("all", 1, length).alias("list"), "ties")


def _salted(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Adds ``salt``: groups of more than ``limit`` rows are cut by hash of the node."""
    large = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("parts"))
    return rows.join(large, keys, "left").withColumn("salt", F.pmod(F.xxhash64("node", *keys), F.coalesce("parts", F.lit(1)))).drop("parts")


def _blocks(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return rows.groupBy(*keys, "salt").agg(F.collect_list(F.struct("node", "unit", *more)).alias("members"))


def _counted(threshold: float):
    """Pairs of member blocks -> (node, n, other): links of each node (copies counted), and the edges that hold their classes together."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("same")[k].as_py()
                na, a = _stack(batch.column("left")[k], "<f8")
                nb, b = (na, a) if same else _stack(batch.column("right")[k], "<f8")
                ca = batch.column("left")[k].values.field("copies").to_numpy(zero_copy_only=False)
                sims = a @ b.T
                links = sims >= threshold
                if same:
                    np.fill_diagonal(links, False)
                    label = _classes(links)
                    far = label != np.arange(len(label))
                    pairs = (na[far], na[label[far]])
                    nodes, n = na, links @ ca
                else:
                    both = np.zeros((len(na) + len(nb),) * 2, dtype=bool)
                    both[: len(na), len(na) :] = links
                    both |= both.T
                    label, every = _classes(both), np.concatenate([na, nb])
                    far = label != np.arange(len(label))
                    pairs = (every[far], every[label[far]])
                    cb = batch.column("right")[k].values.field("copies").to_numpy(zero_copy_only=False)
                    nodes, n = every, np.concatenate([links @ cb, ca @ links])
                some = n > 0
                m = int(some.sum())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(n[some].astype(np.int64)), pa.nulls(m, pa.int64())], names=["node", "n", "other"])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(np.zeros(len(pairs[0]), dtype=np.int64)), pa.array(pairs[1], pa.int64())], names=["node", "n", "other"])

    return work


def _exact(units: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Candidate components -> (node, n, other) of their true links."""
    members = units.join(groups, "node").select("node", "unit", "copies", F.col("component").alias("comp"))
    rows = materialize(_blocks(_salted(members, ["comp"], PAIR_BLOCK), ["comp"], "copies"), "component-blocks")
    left = rows.select("comp", F.col("salt").alias("i"), F.col("members").alias("left"))
    # a pair of blocks is a key of its own, so that a large component is dealt over many tasks
    cut = small_side(rows.groupBy("comp").agg((F.max("salt") + 1).alias("parts")).where("parts > 1"))
    pairs = rows.join(cut, "comp")
    first = pairs.where("salt + 1 < parts").select("comp", F.col("salt").alias("i"), F.explode(F.expr("sequence(salt + 1, parts - 1)")).alias("j"), F.col("members").alias("left"))
    second = pairs.where("salt > 0").select("comp", F.explode(F.expr("sequence(0, salt - 1)")).alias("i"), F.col("salt").alias("j"), F.col("members").alias("right"))
    across = first.join(second, ["comp", "i", "j"]).select("left", "right", F.lit(False).alias("same"))
    within = left.select("left", F.col("left").alias("right"), F.lit(True).alias("same"))
    return materialize(within.unionByName(across).mapInArrow(_counted(threshold), "node long, n long, other long"), "link-counts")


def _audit(units: DataFrame, counts: DataFrame, threshold: float, size: int) -> tuple[float, int]:
    """(recall against all rows, links it rests on). The recall is the least of: share of the sample's links, mean share
    of a vector's links, and that mean for vectors with few links; 1 where the samples have no links."""
    per_node = counts.groupBy("node").agg(F.sum("n").alias("n"))
    known = units.select("node", "unit", "dim").join(per_node, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    draw = lambda some: some.orderBy(F.xxhash64("node")).limit(size).collect()  # noqa: E731  # bounded by `size`
    every, few = draw(known), draw(known.where(F.col("n") < NEIGHBOURS))
    found = {r["node"]: r["n"] for r in every + few}
    by_dim: dict[int, dict] = {}
    for r in every + few:
        by_dim.setdefault(r["dim"], {})[r["node"]] = bytes(r["unit"])
    held = {d: (np.array(list(some)), np.frombuffer(b"".join(some.values()), dtype="<f8").reshape(len(some), d)) for d, some in by_dim.items()}

    def work(batches):
        for batch in batches:
            for dim, (nodes, x) in held.items():
                some = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                if some.num_rows:
                    y = np.frombuffer(b"".join(some.column("unit").to_pylist()), dtype="<f8").reshape(-1, dim)
                    own, copies = some.column("node").to_numpy(), some.column("copies").to_numpy()
                    n = ((x @ y.T >= threshold) & (nodes[:, None] != own[None, :])) @ copies
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    true = {r["node"]: r["n"] for r in units.select("node", "unit", "dim", "copies").mapInArrow(work, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    shares = []
    for sample in (every, few):
        linked = [r["node"] for r in sample if true[r["node"]]]
        if linked:
            shares.append(float(np.mean([found[k] / true[k] for k in linked])))
            if sample is every:
                shares.append(sum(found[k] for k in linked) / sum(true[k] for k in linked))
    return min(shares, default=1.0), sum(true[k] for k in found)


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("node").alias("u"), F.explode("list").alias("e")).select("u", "e.v", "e.sim", F.lit(False).alias("tie"))


def _tied(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("node").alias("a"), F.explode("ties").alias("b"))


def _with_roots(links: DataFrame) -> DataFrame:
    """(a, b) -> node, component of every linked node, the lowest ones among them."""
    groups = components(links)
    return groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())


def _descended(units: DataFrame, lists: DataFrame, fresh: DataFrame, near: float, keep: int) -> tuple[DataFrame, DataFrame, bool]:
    """NN-descent from the neighbours (u, v) that are ``fresh``, until a round brings no new link: (lists, ties found, whether there was a new link)."""
    ties = units.sparkSession.createDataFrame([], "a long, b long")
    single = units.select("node", "dim", "unit").mapInArrow(_codes(1, 0, 0), "node long, tree long, code long, unit binary").select("node", "unit")
    for k in range(ROUNDS):
        flat = _flat(lists)
        both = flat.select("u", "v").unionByName(fresh)
        around = both.select(F.col("u").alias("pivot"), F.col("v").alias("node")).unionByName(both.select(F.col("v").alias("pivot"), F.col("u").alias("node")))
        ends = fresh.select(F.col("u").alias("pivot")).unionByName(fresh.select(F.col("v").alias("pivot"))).distinct()
        # a vector meets its fresh neighbours too, as a suggested one has not been compared
        around = around.unionByName(ends.select("pivot", F.col("pivot").alias("node"))).distinct().join(ends, "pivot", "left_semi")
        compared = _blocks(_salted(around.join(single, "node"), ["pivot"], 2 * BLOCK), ["pivot"]).select("members")
        found = compared.mapInArrow(_best(near, keep), "u long, v long, sim float, tie boolean")
        # only what beats the end of a list, or ties, goes on
        last = lists.select(F.col("node").alias("u"), F.when(F.size("list") < keep, F.lit(-2.0)).otherwise(F.element_at("list", -1)["sim"]).alias("last"))
        found = found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("tie").alias("tie"))
        found = found.join(last, "u", "left").where(F.col("last").isNull() | (F.col("sim") > F.col("last")) | (F.col("sim") >= near) | F.col("tie")).select("u", "v", "sim", "tie")
        was, lists = lists, materialize(_lists(flat.unionByName(found), near, keep), "lists")
        ties = ties.unionByName(_tied(lists))
        fresh = materialize(_flat(lists).select("u", "v", "sim").join(_flat(was).select("u", "v"), ["u", "v"], "left_anti"), "fresh")
        if not fresh.where(F.col("sim") >= near).limit(1).count():
            return lists, ties, k > 0
        fresh = fresh.select("u", "v")
    return lists, ties, ROUNDS > 0


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> tuple[DataFrame, float, int]:
    """(vec_id, n_links, component_id, kept for every row; audited recall; links of the audit)."""
    spark = vectors.sparkSession
    table = unit_table(vectors)
    units = distinct_units(table)
    n = units.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK)))) if n else 0
    trees = trees_needed(threshold, bits)
    near, ties, keep, recall, audited = threshold - SLACK, None, NEIGHBOURS, 1.0, 0
    counts = spark.createDataFrame([], "node long, n long, other long")

    def forest(number: int, size: int) -> DataFrame:
        return units.select("node", "unit", "dim").mapInArrow(_codes(size, bits, seed + 1000 * number), "node long, tree long, code long, unit binary")

    number, lists = 0, None  # number of the forest
    for _ in range(RESTARTS if n > 1 else 0):
        new = _blocks(_salted(forest(number, 1), ["tree", "code"], 2 * BLOCK), ["tree", "code"]).select("members").mapInArrow(_best(near, keep), "u long, v long, sim float, tie boolean")
        lists = materialize(_lists(new if lists is None else _flat(lists).unionByName(new), near, keep), "lists")
        ties = _tied(lists) if ties is None else ties.unionByName(_tied(lists))
        fresh, suggested = _flat(lists).select("u", "v"), False
        while True:
            lists, found, some = _descended(units, lists, fresh, near, keep)
            ties = ties.unionByName(found)
            links = _flat(lists).where(F.col("sim") >= near).select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(ties)
            groups = materialize(_with_roots(links), "groups")
            # what is joined so far goes on as stars
            ties = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
            if suggested and not some:
                break
            number += 1
            coded = forest(number, trees).join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node"))
            blocks = _blocks(_salted(coded, ["tree", "code"], 2 * BLOCK), ["tree", "code"], "comp").select("members")
            more = materialize(blocks.mapInArrow(_between(near), "a long, b long"), "suggestions")
            if not more.limit(1).count():
                break
            fresh, suggested = more.select(F.col("a").alias("u"), F.col("b").alias("v")), True
        counts = _exact(units, groups, threshold)
        recall, audited = _audit(units, counts, threshold, AUDIT)
        if recall >= TARGET:
            break
        keep *= 2
        number += 1
    if recall < TARGET:  # the search has failed: everything against everything
        counts = _exact(units, units.select("node", F.col("dim").cast("long").alias("component")), threshold)
        recall, audited = _audit(units, counts, threshold, AUDIT)
    per_node = counts.groupBy("node").agg(F.sum("n").alias("others"))
    true = components(counts.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rows = units.select("key", "node", "copies", "first_id").join(per_node, "node", "left").join(true, "node", "left")
    # equal vectors link with each other
    rows = rows.select("key", "copies", "first_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    lowest = rows.where("n_links > 0").groupBy("component").agg(F.min("first_id").alias("lowest"))
    rows = materialize(rows.join(small_side(lowest), "component", "left").select("key", "copies", "n_links", "lowest"), "judged")
    # a vector with very many copies is no key of a shuffle
    many = F.broadcast(rows.where(F.col("copies") >= MANY_COPIES).drop("copies"))
    usual = rows.where(F.col("copies") < MANY_COPIES).drop("copies")
    light = table.select("vec_id", "key")
    rows = light.join(many, "key").unionByName(light.join(many, "key", "left_anti").join(usual, "key", "left"))
    n_links = F.coalesce("n_links", F.lit(0))
    component_id = F.when(n_links > 0, F.col("lowest")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", n_links.alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept")), recall, audited


def query(spark, sf_dir: str) -> DataFrame:
    """op7: links and component of every vector, the audited recall of the run and the number of links it rests on."""
    rows, recall, audited = near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumns({"recall": F.lit(recall), "audited_links": F.lit(audited).cast("long")})
