"""N-gram Jaccard join by a token-group matrix: exact links, one row per document.

A document's set holds its distinct shingles of five lower-cased words; two
documents link when their sets' Jaccard similarity is 0.8 or more. The work
goes from cheap to dear, and every filter is a bound, so no link is lost:

1. Equal texts are joined by digest and go on as one text.
2. *Query against everything else.* By the prefix theorem two linked sets share
   at least l of the first p shingles by hash. Only those are sent out and
   counted; a text with fewer than l shared ones links with nothing. A batch
   that holds a shingle several times sends it once.
3. Equal sets are joined, and similar ones are put into groups: same lowest
   shared shingle, cut into blocks of a bounded number of sets.
4. Inside a block all sets are compared by one matrix product. The first of
   every large cluster of a block speaks for it: these few are linked among
   themselves first, in the same way. So the blocks of one family of near
   copies become one component before any two of them are compared.
5. *Token-group matrix.* Each block's union of shingles is stored. The query
   sets of a block are sent by their rarest shingles, once for all of them, to
   the blocks whose union holds one; the overlap of query and union bounds the
   overlap with every member, and only for queries that reach the threshold
   the block is opened. Blocks that lie in one component have nothing to tell
   each other: only shingles that several components hold are sent.
6. Links become connected components.

Within a block (and between a query and a block) one link for each cluster of
members is enough for the components, so neither links nor pairs of blocks
grow with the square of a group of copies.

Defined results: null text, or one without words, has an empty set and links
with nothing; rows that share a doc_id are one node of the graph and get a row
each; a null doc_id links with nothing and has no component; equal texts link;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import common_keys, hex_digest, join_counted, materialize, small_side, tidy
from ._graph import components
from ._words import first_of_equal, shingle_set

SHINGLE = 5
#: The threshold as a percentage.
PERCENT = 80
#: Sets in a block, about, and the least members of a cluster whose first one speaks for it.
BLOCK, FAMILY = 128, 8
#: Shingles in a block, about (8 bytes each): a block of longer sets has fewer of them, but for a single one.
BLOCK_TOKENS = 4_000_000
#: Columns of a matrix of sets that are held at once.
COLUMNS = 65_536


def overlap_needed(n, percent: int = PERCENT):
    """Fewest shared elements of a set of n with any set that it links to: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _extra(n):
    """The l of the l-prefix: a tenth of the set."""
    return np.maximum(1, n // 10)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return int(min(n, n - overlap_needed(n, percent) + _extra(n)))


def _scan(shingle: int, percent: int):
    """Texts -> one row per prefix shingle and one row per text (those with h)."""

    def work(batches):
        for batch in (b.slice(k, 4000) for b in batches for k in range(0, b.num_rows, 4000)):
            ids, hs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            ns = np.array([len(s) for s in sets], dtype=np.int64)
            # two hashes of the whole set; the empty set has its own
            keys = np.array([[hash_of(s, 0), hash_of(s, 1)] for s in sets], dtype=np.int64).reshape(-1, 2)
            prefix = [s[: prefix_length(len(s), percent)] if len(s) else s for s in sets]
            owner = np.repeat(np.arange(len(sets)), [len(p) for p in prefix])
            tokens = np.concatenate(prefix) if prefix else np.empty(0, dtype=np.uint64)
            # a shingle that this batch holds several times: one row speaks for it, the others are known to be shared
            first, held = first_of_equal(tokens)
            salt = np.where(first, 0, 1 + (keys[owner, 0].astype(np.uint64) ^ tokens) % np.uint64(1_000_003)).astype(np.int32)
            weight = np.minimum(held, 2).astype(np.int32)
            for k in range(0, len(tokens), 200_000):
                s = slice(k, k + 200_000)
                m = len(tokens[s])
                yield pa.RecordBatch.from_arrays(
                    [tokens[s].view(np.int64), salt[s], weight[s], ids[owner[s]], keys[owner[s], 0], pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())],
                    names=NAMES,
                )
            m = len(sets)
            yield pa.RecordBatch.from_arrays([keys[:, 0], np.full(m, -1, np.int32), np.zeros(m, np.int32), ids, keys[:, 0], ns, hs, keys[:, 1]], names=NAMES)

    return work


NAMES = ["token", "salt", "weight", "doc_id", "key", "n", "h", "key2"]
_SCHEMA = "token long, salt int, weight int, doc_id long, key long, n long, h string, key2 long"


def hash_of(tokens: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=seed)).astype(np.int64))


def _token_sets(shingle: int):
    """Texts that are still in question -> their sets; rows of another text with the same id are left out."""

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = []
                for doc, text, key, group, salt in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns), strict=True):
                    tokens = shingle_set(text, shingle)
                    if hash_of(tokens, 0) == key:
                        rows.append((doc, group, salt, len(tokens), tokens.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "grp", "salt", "n", "tokens"])

    return work


def _shared(a: list[np.ndarray], b: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Shared elements of each set of ``a`` with each of ``b`` among those of ``union`` (all sorted): products of 0/1
    matrices over ``COLUMNS`` columns at a time, so memory does not grow with the sets."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(0, len(union), COLUMNS):
        columns = union[k : k + COLUMNS]
        x = _matrix(a, columns)
        out += np.rint(x @ (x if b is a else _matrix(b, columns)).T).astype(np.int64)
    return out


def _held(tokens: np.ndarray, union: np.ndarray) -> int:
    """How many of the tokens the union holds."""
    at = np.searchsorted(union, tokens)
    inside = at < len(union)
    return int((union[at[inside]] == tokens[inside]).sum())


def _matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 rows of the sets over some columns; elements outside are left out."""
    out = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for k, s in enumerate(sets):
        s = s[np.searchsorted(s, columns[0]) : np.searchsorted(s, columns[-1], side="right")]
        at = np.searchsorted(columns, s)
        out[k, at[columns[at] == s]] = 1
    return out


def _linked(shared: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (na[:, None] + nb[None, :] - shared)


def _classes(links: np.ndarray) -> np.ndarray:
    """Connected classes of a symmetric boolean matrix: the lowest index of each."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sets(row_tokens) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint64) for t in row_tokens]


def _inner(sets: list[np.ndarray], ns: np.ndarray, percent: int) -> np.ndarray:
    """Classes within a block; shingles of one member only need no column."""
    union, held = np.unique(np.concatenate(sets), return_counts=True)
    return _classes(_linked(_shared(sets, sets, union[held > 1]), ns, ns, percent))


def _block_links(percent: int):
    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column("members")[k].as_py()
                if len(members) < 2:
                    continue
                ids, ns = np.array([m["doc_id"] for m in members]), np.array([m["n"] for m in members])
                label = _inner(_sets(m["tokens"] for m in members), ns, percent)
                far = label != np.arange(len(label))
                # where a block has no room for a family, one link tells as much as a family's
                weight = FAMILY - 1 if len(members) < FAMILY and 2 * FAMILY * ns.max() > BLOCK_TOKENS else 1
                yield pa.RecordBatch.from_arrays([ids[far], ids[label[far]], np.full(int(far.sum()), weight, np.int32)], names=["a", "b", "weight"])

    return work


def _unions(batches):
    """Blocks -> (token, block, comp): each block's union of shingles."""
    for batch in batches:
        for k in range(batch.num_rows):
            members, block, comp = (batch.column(c)[k].as_py() for c in ("members", "block", "comp"))
            union = np.unique(np.concatenate(_sets(m["tokens"] for m in members))).view(np.int64)
            for j in range(0, len(union), 200_000):
                n = len(union[j : j + 200_000])
                yield pa.RecordBatch.from_arrays([union[j : j + 200_000], np.full(n, block), np.full(n, comp)], names=["token", "block", "comp"])


def _probes(percent: int):
    """Blocks with their shared tokens -> (token, block): the rarest ones of every member that can still link outside."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                shared = batch.column("shared")[k].values
                token = shared.field("token").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                blocks = shared.field("blocks").to_numpy(zero_copy_only=False)
                at = np.argsort(token)
                token, blocks = token[at], blocks[at]
                out = []
                for m in batch.column("members")[k].as_py():
                    tokens = np.frombuffer(m["tokens"], dtype=np.uint64)
                    j = np.searchsorted(token, tokens)
                    j[j == len(token)] = 0
                    there = token[j] == tokens
                    need, n = overlap_needed(m["n"], percent), m["n"]
                    if there.sum() < need:  # bound by the union of all other blocks
                        continue
                    mine, rare = tokens[there], blocks[j[there]]
                    # any n - need + 1 elements hold one of a linked set; those of no other block need not be sent
                    take = n - need + 1 - int((~there).sum())
                    out.append(mine[np.lexsort((mine, rare))[:take]])
                if out:  # once for all members of the block
                    sent = np.unique(np.concatenate(out)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([sent, np.full(len(sent), block)], names=["token", "block"])

    return work


def _choose(percent: int):
    """(members of a block, another block's sizes and the probes that its union holds) -> the queries that it is opened for."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                least, most = batch.column("to_least")[k].as_py(), batch.column("to_most")[k].as_py()
                held = np.unique(batch.column("held")[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                queries = []
                for m in batch.column("members")[k].as_py():
                    if m["n"] * percent > most * 100 or least * percent > m["n"] * 100:
                        continue
                    tokens = np.frombuffer(m["tokens"], dtype=np.uint64)
                    at = np.searchsorted(tokens, held)
                    at[at == len(tokens)] = 0
                    if (tokens[at] == held).any():
                        queries.append(m)
                if queries:
                    yield pa.RecordBatch.from_arrays([batch.column("to").slice(k, 1), pa.array([queries], _ARROW_MEMBERS)], names=["to", "queries"])

    return work


def _open(percent: int):
    """(members of one block, members of another) -> links: one for each query of the first and class of the second."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                queries, members = batch.column("queries")[k].as_py(), batch.column("members")[k].as_py()
                sets, qsets = _sets(m["tokens"] for m in members), _sets(m["tokens"] for m in queries)
                ns, qn = np.array([m["n"] for m in members]), np.array([m["n"] for m in queries])
                both = np.intersect1d(np.concatenate(sets), np.concatenate(qsets))  # each token once
                good = np.array([_held(x, both) for x in qsets]) >= overlap_needed(qn, percent)  # the query-group bound
                if not good.any():
                    continue
                links = _linked(_shared([x for x, g in zip(qsets, good, strict=True) if g], sets, both), qn[good], ns, percent)
                if not links.any():
                    continue
                label = _inner(sets, ns, percent)
                a, b = np.nonzero(links)
                pairs = np.unique(np.stack([np.flatnonzero(good)[a], label[b]]), axis=1)
                qid, mid = np.array([m["doc_id"] for m in queries]), np.array([m["doc_id"] for m in members])
                yield pa.RecordBatch.from_arrays([qid[pairs[0]], mid[pairs[1]]], names=["a", "b"])

    return work


_MEMBERS = "array<struct<doc_id:bigint,n:bigint,tokens:binary>>"
_ARROW_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())]))


def set_table(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every row's doc_id and text digest; every distinct text: doc_id, h, n, key, key2, hits, grp; rows of each text digest that has several)."""
    light = materialize(docs.select(F.col("doc_id").cast("long"), hex_digest(F.coalesce("text", F.lit(""))).alias("h")), "texts")
    first = light.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    first = materialize(first.where("rows > 1"), "first-texts")
    copies = join_counted(light, first, "h", "rows", light.count()).where("doc_id > first").select("doc_id", "h").distinct()
    copies = materialize(copies, "copies")
    texts = docs.select(F.col("doc_id").cast("long"), "text", hex_digest(F.coalesce("text", F.lit(""))).alias("h")).where("doc_id is not null")
    texts = texts.join(small_side(copies), ["doc_id", "h"], "left_anti")
    rows = texts.select("doc_id", "text", "h").mapInArrow(tidy(_scan(shingle, percent)), _SCHEMA)
    held = F.sum("weight").over(Window.partitionBy("token", "salt"))
    rows = rows.withColumn("held", held).where("held > 1 or h is not null")
    table = rows.groupBy("doc_id", "key").agg(
        F.collect_set("h").alias("h"),  # several only if one id has several texts of one set
        F.max("n").alias("n"),
        F.max("key2").alias("key2"),
        F.count_if(F.col("h").isNull()).alias("hits"),
        F.min(F.when(F.col("h").isNull(), F.col("token"))).alias("grp"),
    )
    return light, materialize(table, "sets"), first.select("h", "rows")


def links(docs: DataFrame, table: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose connected components are those of all links between distinct texts."""
    table = table.where("n > 0")
    by_key = Window.partitionBy("key", "key2", "n")
    table = materialize(table.withColumn("rep", F.min("doc_id").over(by_key)), "set-classes")
    equal = table.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # fewest shared shingles in the prefix: a partner may be as small as ceil(n * percent / 100), and its l is a tenth of that
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    ask = table.where((F.col("doc_id") == F.col("rep")) & (F.col("hits") >= need)).select("doc_id", "key", "grp", "n")
    ask = materialize(_salted(ask, block).drop("n"), "asked")
    n_ask = ask.count()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(ask, n_ask), "doc_id")
    sets = texts.select("doc_id", "text", "key", "grp", "salt").mapInArrow(tidy(_token_sets(shingle)), "doc_id long, grp long, salt int, n long, tokens binary")
    return equal.unionByName(_link_sets(sets, percent, block))


def _salted(rows: DataFrame, block: int) -> DataFrame:
    """Adds ``salt``: groups of more than ``block`` sets, or more than ``BLOCK_TOKENS`` shingles (n), are cut by hash."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_TOKENS))
    per = rows.groupBy("grp").agg(parts.alias("parts"))
    return rows.join(per, "grp").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).drop("parts")


def _link_sets(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(doc_id, grp, salt, n, tokens) -> (a, b): links whose connected components are those of all links between the sets."""
    member = F.struct("doc_id", "n", "tokens")
    blocks = sets.groupBy("grp", "salt").agg(F.collect_list(member).cast(_MEMBERS).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    blocks = materialize(blocks.withColumn("block", F.xxhash64("grp", "salt")).select("block", "grp", "least", "most", "members"), "blocks")
    found = materialize(blocks.select("members").mapInArrow(tidy(_block_links(percent)), "a long, b long, weight int"), "inner-links")
    # the first ones of large clusters are linked first; each time there are at most half of them left
    first = materialize(found.groupBy("b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= FAMILY - 1).select(F.col("b").alias("doc_id")), "first-ones")
    found = found.select("a", "b")
    n_first = first.count()
    if n_first > block or n_first > 1 and blocks.agg(F.max("most")).first()[0] * n_first > BLOCK_TOKENS:
        inside = blocks.select("grp", F.explode("members").alias("m")).select("grp", "m.*").join(small_side(first, n_first), "doc_id", "left_semi")
        salts = _salted(inside.select("doc_id", "grp", "n"), block).select("doc_id", "salt")
        found = found.unionByName(_link_sets(inside.join(small_side(salts, n_first), "doc_id"), percent, block))
    # a block whose members are all in one component bears its name, any other a name of its own
    each = blocks.select("block", F.explode("members.doc_id").alias("doc_id")).join(components(found), F.col("doc_id") == F.col("node"), "left")
    of = each.groupBy("block").agg(F.min(F.coalesce("component", "doc_id")).alias("low"), F.max(F.coalesce("component", "doc_id")).alias("high"))
    named = F.when(F.col("low") == F.col("high"), F.xxhash64(F.lit("component"), "low")).otherwise(F.xxhash64(F.lit("block"), "block"))
    comps = small_side(materialize(of.select("block", named.alias("comp")), "block-components"))
    unions = blocks.join(comps, "block").select("block", "comp", "members").mapInArrow(tidy(_unions), "token long, block long, comp long")
    # in how many blocks a token is, and whether of several components: counted first by partial sums, then given back to its blocks
    same = Window.partitionBy("token")
    matrix = unions.withColumns({"blocks": F.count(F.lit(1)).over(same), "low": F.min("comp").over(same), "high": F.max("comp").over(same)}).where("low <> high")
    shared = matrix.groupBy("block").agg(F.collect_list(F.struct("token", "blocks")).alias("shared"))
    shared = materialize(shared, "matrix")
    probes = blocks.join(shared, "block").select("block", "members", "shared").mapInArrow(tidy(_probes(percent)), "token long, block long")
    probes = materialize(probes, "probes").join(comps, "block")
    index = shared.select(F.col("block").alias("to"), F.explode("shared").alias("s")).select("to", "s.token").join(comps.withColumnsRenamed({"block": "to", "comp": "to_comp"}), "to")
    held = probes.join(index, "token").where("to < block and comp <> to_comp").groupBy("block", "to").agg(F.collect_list("token").alias("held"))
    sizes = blocks.select(F.col("block").alias("to"), F.col("least").alias("to_least"), F.col("most").alias("to_most"))
    held = held.join(sizes, "to").join(blocks.select("block", "members"), "block").select("to", "to_least", "to_most", "held", "members")
    # only the queries in question travel to the block that is opened
    asked = held.mapInArrow(tidy(_choose(percent)), f"to long, queries {_MEMBERS}")
    opened = asked.join(blocks.select(F.col("block").alias("to"), "members"), "to").select("queries", "members")
    outer = materialize(opened.mapInArrow(tidy(_open(percent)), "a long, b long"), "outer-links")
    return found.unionByName(outer)


def join_similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    light, table, counts = set_table(docs, shingle, percent)
    found = links(docs, table, shingle, percent)
    # rows of one text point at its first document
    per_text = table.where("n > 0").withColumn("h", F.explode("h")).groupBy("h").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    per_text = per_text.join(counts, "h", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    per_text = materialize(per_text, "text-sets")
    total = light.count()
    # one document with several texts ties their classes together
    several = light.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id")
    tied = join_counted(light.join(small_side(materialize(several, "several-texts")), "doc_id", "left_semi"), per_text, "h", "rows", total)
    tied = tied.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    groups = components(found.unionByName(tied))
    per_text = materialize(per_text.join(groups, F.col("first") == F.col("node"), "left").select("h", "first", "n", "rows", "component"), "text-components")
    rows = join_counted(light, per_text, "h", "rows", total)
    known = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first")).alias("component_id"))
    # the others have no words
    return known.unionByName(_without(light, per_text, total).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _without(light: DataFrame, per_text: DataFrame, total: int) -> DataFrame:
    """Rows whose text has no set."""
    common, others = common_keys(per_text.select("h", "rows"), "rows", total)
    return light.join(F.broadcast(common), "h", "left_anti").join(others, "h", "left_anti")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that link to a document of lower id; of rows with one id and one text, one stays.

    Rows without an id link with nothing and stay; so do rows of one id that hold different texts.
    """
    judged = join_similar(docs, shingle, percent)
    gone = materialize(judged.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    # a whole row is one column from here on, so none of its names meets one of ours
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    held = held.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), hex_digest(F.coalesce("row.text", F.lit(""))).alias("h"))
    kept = held.join(small_side(gone), "doc_id", "left_anti")
    several = kept.where("doc_id is not null").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    several = small_side(materialize(several, "repeated"))
    keys = ["doc_id", "h"]
    # equal rows are brought down to one before they meet
    first = kept.join(several, keys, "left_semi").groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(several, keys, "left_anti").select("row").unionByName(first.select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the similarity class of every document."""
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
