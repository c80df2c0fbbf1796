"""Conversation prefix trie, rolled up in bands of fixed height.

Every distinct sequence of first turns of the conversations is a node; the node
of depth 0 is the root. Families of ``FAMILY`` conversations share their
opening: conversation c takes its first h turns (h from the CRC-32 of its
number) from the conversation ``c - c % FAMILY``.

1. Walk: the turns of a family are sorted behind each other and read one at a
   time. A node's id is the digest of its parent's id and its last turn, so
   equal prefixes have equal ids in all conversations. Only digests and sizes of
   turns are shuffled, never texts.
2. Nodes: ids are grouped with their smallest member and number of members,
   pre-aggregated before the shuffle.
3. Rollup: depths are cut into bands of ``BAND`` depths. A node adds its own
   figures to itself and its ancestors within its band, at most ``BAND`` rows.
   The roots of the bands are then a trie of a ``BAND``-th of the depth, which is
   rolled up in the same way; a completed band root adds its total to the
   ancestors in the band above. So a trie of depth D takes log(D) rounds to the
   base ``BAND``, and no node ever explodes to more than ``BAND`` ancestors a round.
   For that a node carries its ancestors in its band, and one whose depth is a
   multiple of BAND, BAND squared, ... those in the coarser bands too.
4. The ids of the conversations that end at a node are hashed in ascending
   order: sorted over all tasks by (node, conversation), put together to chunks
   there, and the chunks of a node hashed one after the other.

A group's rows are never held: the walk keeps the family's first ``OPENING`` turns
and ``BAND`` ids a level, a chunk has at most ``CHUNK`` characters. One
conversation is read by one task, as each node's id needs the one before; so are
the chunks of one node, as SHA-256 has to read its input in order.

Defined results: null role or text is empty; turns are ordered by turn (null
first), ties by the digest of (role, text), and repeated rows are repeated turns;
rows without a conv_id belong to no conversation and are left out; a
conversation whose rebuilt sequence is empty is a member of the root and ends there; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, materialize

#: Conversations that share an opening, and the most turns of it (an opening's length is a number modulo OPENING + 1).
FAMILY, OPENING = 5, 8
#: Depths of a band.
BAND = 8
#: Characters of conversation ids that are put together before they are hashed.
CHUNK = 65_536
#: Rows of a batch that the walk gives.
ROWS = 5_000

ROOT = bytes(16)
WALK = "conv_id long, node binary, depth int, parent binary, bytes long, ends boolean, paths array<array<binary>>"
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("node", pa.binary()),
        ("depth", pa.int32()),
        ("parent", pa.binary()),
        ("bytes", pa.int64()),
        ("ends", pa.bool_()),
        ("paths", pa.list_(pa.list_(pa.binary()))),
    ]
)


def opening_length(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (OPENING + 1)).cast("int")


class _Path:
    """Ids on the way to the present node: per level those of its band so far."""

    def __init__(self):
        self.depth, self.node = 0, ROOT
        self.bands: list[list[bytes]] = []

    def step(self, digest: bytes) -> tuple:
        """Goes one turn down: (node, depth, parent, paths)."""
        parent, depth, step, level = self.node, self.depth, 1, 0
        # the node that is left enters the bands of all levels that its depth belongs to
        while depth % step == 0:
            if level == len(self.bands):
                self.bands.append([ROOT])
            if depth == 0:
                break
            if depth // step % BAND == 0:
                self.bands[level] = [parent]
            else:
                self.bands[level].append(parent)
            step, level = step * BAND, level + 1
        self.depth, self.node = depth + 1, hashlib.blake2b(parent + digest, digest_size=16).digest()
        paths, step, level = [], 1, 0
        while self.depth % step == 0:
            paths.append(list(self.bands[level]) if level < len(self.bands) else [ROOT])
            step, level = step * BAND, level + 1
        return self.node, self.depth, parent, paths


def _walk(batches):
    """Sorted rows (family, conv_id, opening, digest, bytes), the family's first conversation before the others -> ``WALK``."""
    out: list[tuple] = []
    family = conv = None
    lead: list[tuple] = []  # the opening turns of the family's first conversation
    skip, path, held = 0, None, None

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
        out.clear()
        return made

    for rows in batches:
        for fam, own, opening, digest, size in zip(*(rows.column(n).to_pylist() for n in ("family", "conv_id", "opening", "digest", "bytes")), strict=True):
            if own != conv:
                if held is not None:
                    out.append((conv, *held[:4], True, held[4]))
                if fam != family:
                    family, lead = fam, []
                conv, path = own, _Path()
                held, skip = (ROOT, 0, None, 0, []), 0
                if own != fam:
                    skip = opening
                    for d, n in lead[:opening]:
                        out.append((conv, *held[:4], False, held[4]))
                        node, depth, parent, paths = path.step(d)
                        held = (node, depth, parent, n, paths)
            if skip:
                skip -= 1
                continue
            if own == fam and len(lead) < OPENING:
                lead.append((digest, size))
            out.append((conv, *held[:4], False, held[4]))
            node, depth, parent, paths = path.step(digest)
            held = (node, depth, parent, size, paths)
            if len(out) >= ROWS:
                yield batch()
    if held is not None:
        out.append((conv, *held[:4], True, held[4]))
    if out:
        yield batch()


def walk(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one row per rebuilt conversation and depth, the root included: ``WALK``.

    ``ends`` marks a conversation's last node; ``paths`` holds, per level, the ids of the ancestors in the node's band
    (of a band's root: those in the band above), from the top.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).cast("long").alias("family"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        opening_length(F.col("conv_id")).alias("opening"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    dealt = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return dealt.drop("turn").mapInArrow(_walk, WALK)


def _rolled_up(nodes: DataFrame, deepest: int, sums: list[str], level: int = 0) -> DataFrame:
    """(node, depth, paths, sums) -> node and the sums over its subtree. ``nodes`` are those of ``level``: all at 0, then
    the band roots of the level before, whose sums cover their bands."""
    step = BAND**level
    inside = (F.col("depth") / step).cast("long") % BAND != 0
    added = [F.sum(c).alias(c) for c in sums]
    own = nodes.where(~inside).select("node", *sums)
    spread = nodes.where(inside).select(F.explode(F.concat(F.array("node"), F.element_at("paths", level + 1))).alias("node"), *sums)
    band = materialize(own.unionByName(spread).groupBy("node").agg(*added), "trie-band")
    if deepest // step < BAND:
        return band
    roots = nodes.where(~inside).select("node", "depth", "paths")
    done = materialize(_rolled_up(roots.join(band, "node"), deepest, sums, level + 1), "trie-roots")
    # a completed root's total goes to its ancestors in the band above, but for that band's root, which is complete
    below = roots.where("depth > 0").join(done, "node").select(F.explode(F.slice(F.element_at("paths", level + 1), 2, BAND)).alias("node"), *sums)
    rest = band.join(roots.select("node"), "node", "left_anti")
    return done.unionByName(rest.unionByName(below).groupBy("node").agg(*added))


def _chunks(batches):
    """Sorted (node, conv_id) -> node, first (conversation of the chunk), ids (joined by commas)."""
    node, ids, length = None, [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])

    for rows in batches:
        for k, conv in zip(rows.column("node").to_pylist(), rows.column("conv_id").to_pylist(), strict=True):
            if ids and (k != node or length > CHUNK):
                yield batch()
                ids, length = [], 0
            node = k
            ids.append(conv)
            length += 20
    if ids:
        yield batch()


def _hashed(batches):
    """Sorted (node, first, ids) -> node, ends_sha256."""
    node, state, nodes, hashes = None, None, [], []
    for rows in batches:
        for k, ids in zip(rows.column("node").to_pylist(), rows.column("ids").to_pylist(), strict=True):
            if k == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                nodes.append(node)
                hashes.append(state.hexdigest())
            node, state = k, hashlib.sha256(ids.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes)], names=["node", "ends_sha256"])
            nodes, hashes = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, conv_id) -> node, ends_sha256: digest of the node's conversations, ascending, joined by commas."""
    spread = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = spread.mapInArrow(_chunks, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").drop("first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: node (id), conv_id (smallest member), depth, parent (id), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes that members of a shared prefix need not be computed again for), ends_sha256."""
    walked = materialize(walk(conversations), "trie-walk")
    nodes = walked.groupBy("node", "depth", "parent", "bytes", "paths").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.where("node is not null"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "trie-children")
    size = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    own = nodes.select(
        "node",
        "depth",
        "paths",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    totals = _rolled_up(own, size[1] or 0, ["n_leaves", "saved_tokens"])
    rows = nodes.select("node", "conv_id", "depth", "parent", "n_convs", "n_children").join(totals, "node")
    rows = rows.join(ends_digest(walked.where("ends").select("node", "conv_id")), "node", "left")
    rows = rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    # the parent's smallest member; children of common parents do not meet in one task
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_counted(rows.where("parent is not null").withColumnRenamed("n_children", "own_children"), parents, "parent", "n_children", size[0])
    below = below.drop("n_children").withColumnRenamed("own_children", "n_children")
    return below.unionByName(rows.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the trie of the rebuilt conversations, one row per node."""
    rows = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    figures = ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return rows.select("conv_id", *[F.col(c).cast("long").alias(c) for c in figures], "ends_sha256")


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS nth, digest, strlen(text) AS bytes
  FROM r),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS family,
         xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
             lambda crc, b: list_reduce(range(8), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
             4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM r)),
rebuilt AS (
  SELECT c.conv_id, o.nth, o.digest, o.bytes FROM c JOIN o ON o.conv_id = c.family AND o.nth <= c.h
  UNION ALL
  SELECT c.conv_id, o.nth, o.digest, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.nth > c.h),
lists AS (
  SELECT c.conv_id, coalesce(list(digest ORDER BY nth) FILTER (WHERE digest IS NOT NULL), []) AS turns,
         coalesce(list(bytes ORDER BY nth) FILTER (WHERE digest IS NOT NULL), []) AS sizes
  FROM c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id),
steps AS (
  SELECT conv_id, turns, sizes, unnest(range(0, len(turns) + 1)) AS depth FROM lists),
prefixes AS (
  SELECT conv_id, depth, array_to_string(turns[1:depth], ',') AS node, array_to_string(turns[1:depth - 1], ',') AS parent,
         CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS bytes, depth = len(turns) AS ends
  FROM steps),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, any_value(bytes) AS bytes, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, depth)),
up AS (
  SELECT left(node, greatest(65 * d - 1, 0)) AS node, d AS depth, (n_children = 0)::INT AS leaf, (n_convs - 1) * bytes AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes)),
total AS (SELECT node, depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN total t USING (node, depth)
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1
"""
