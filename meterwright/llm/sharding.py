"""Sharding by proportional stratified interleaving (law: ``rows``).

Within each source the rows are put in a seeded random order, and the row of
rank r of n (from 0) gets the fractional rank (r + phase) / n, where the phase
in [0, 1) is drawn once per source, so that sources of few rows are not all
found in the middle. All rows sorted by fractional rank are an even
interleaving of the sources. The order is cut into shards of equal numbers of rows, at most one apart;
a shard is a stretch of the order, so it holds of every source its share of a
shard, within a few rows: it matches the mixture.

Neither a source nor the order as a whole is sorted in one task. The random
order is that of a digest, which is cut into as many cells as a cell has rows, but of no more than ``CELL_ROWS``;
cells are counted, the counts summed up along the order, and rows are numbered
within their cell only. The same is done again with cells of fractional rank.
Rows that are repeated (same doc_id, source and text) are counted as one row
with copies until they have their ranks, so a group of repeated rows is no
large cell either; their copies are dealt out in runs of at most ``RUN``.

All of it works on light rows: doc_id, source, size and digests. Whole documents are
moved only by ``write_shards``, which writes one folder of Parquet files per
shard, in the order of the slots.

Defined results: null text has no bytes and CRC-32 0; a null source is a source
of its own, ordered last; null doc_ids are drawn like others; repeated rows are
placed one by one; fewer rows than shards leave some shards empty; an empty table
gives an empty result; other columns are ignored, and kept by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, unused

SHARDS = 24
SEED = "shard-1"
#: Bytes that a document has besides its text.
FRAME = 8
#: Most rows that are numbered in one group on average, and copies of one row that one task deals out.
CELL_ROWS, RUN = 50_000, 10_000
#: The random order is that of a number of so many bits.
DRAW_BITS = 60


def fraction(seed: str, value: Column) -> Column:
    """A number in [0, 1) drawn from the seed and the value."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), value).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def light_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, digest (of the text), draw (place in the random order, an integer)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.md5(raw)
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest).cast("binary"))
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        (F.octet_length(raw) + FRAME).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(digest).alias("digest"),
        F.conv(F.substring(drawn, 1, DRAW_BITS // 4), 16, 10).cast("long").alias("draw"),
    )


def _before(rows: DataFrame, by: list[str], cell: str, n: Column) -> DataFrame:
    """``by``, ``cell``, ``before``: how many rows (sum of ``n``) lie in earlier cells. One row per cell goes through the window."""
    along = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*by, cell).agg(F.sum(n).alias("n"))
    return counted.select(*by, cell, F.coalesce(F.sum("n").over(along), F.lit(0).cast("long")).alias("before"))


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """docs -> doc_id, source, size, text_crc32, digest, nth (among repeated rows), place, shard, slot, one row per document row.

    ``place`` is the row's place in the whole order, from 0; the last three are gapless.
    """
    key = ["doc_id", "source", "size", "text_crc32", "digest", "draw"]
    light = light_rows(docs, seed).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    light = materialize(light, "shard-rows")
    total = light.agg(F.sum("copies")).first()[0] or 0
    # as many cells as rows in a cell, so that neither a cell nor the list of cells is large
    cells = max(-(-max(total, 1) // CELL_ROWS), math.isqrt(max(total, 1)))
    width = -(-(1 << DRAW_BITS) // cells)
    # ranks within the source
    celled = light.withColumn("cell", F.expr(f"draw div {width}L"))
    before = _before(celled, ["source"], "cell", F.col("copies")).withColumnsRenamed({"source": "b_source", "cell": "b_cell"})
    within = Window.partitionBy("source", "cell").orderBy("draw", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = celled.withColumn("inside", F.coalesce(F.sum("copies").over(within), F.lit(0).cast("long")))
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("cell") == F.col("b_cell")))
    of_source = light.groupBy(F.col("source").alias("s_source")).agg(F.sum("copies").alias("rows"))
    ranked = ranked.join(of_source, F.col("source").eqNullSafe(F.col("s_source")))
    ranked = ranked.select(*key[:5], "copies", "rows", (F.col("before") + F.col("inside")).alias("rank"))
    # copies one by one; those of a row of very many are dealt over tasks run by run
    one = ranked.where("copies = 1").select(*key[:5], "rows", "rank", F.lit(0).cast("long").alias("nth"))
    runs = ranked.where("copies > 1").select("*", F.explode(F.expr(f"sequence(0L, copies - 1, {RUN}L)")).alias("run"))
    more = runs.repartition("doc_id", "digest", "run").select("*", F.explode(F.expr(f"sequence(run, least(run + {RUN}, copies) - 1)")).alias("nth"))
    placed = one.unionByName(more.select(*key[:5], "rows", (F.col("rank") + F.col("nth")).alias("rank"), "nth"))
    phase = fraction(seed, F.coalesce(F.col("source"), F.lit("\u0000null")))
    placed = placed.withColumn("part", (F.col("rank") + phase) / F.col("rows"))
    # places in the order of all sources
    placed = materialize(placed.withColumn("cell", F.floor(F.col("part") * cells).cast("long")).drop("rows", "rank"), "shard-ranks")
    before = _before(placed, [], "cell", F.lit(1)).withColumnRenamed("cell", "b_cell")
    within = Window.partitionBy("cell").orderBy("part", F.col("source").asc_nulls_last())
    placed = placed.withColumn("inside", F.row_number().over(within)).join(before, F.col("cell") == F.col("b_cell"))
    placed = placed.withColumn("place", F.col("before") + F.col("inside") - 1)
    # shard k holds the places from ceil(k * total / shards)
    shard = F.expr(f"place * {shards} div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
    return placed.select(*key[:5], "nth", "place", F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Writes the documents, all columns kept, to ``path/shard=K`` and returns the manifest: shard, rows, bytes, sources.

    Files are cut by ranges of slots, so a shard may have as many files as its size asks for; within them rows are in
    the order of the slots. A column named ``shard`` or ``slot`` of the documents keeps its name, ours get another one.
    """
    names = docs.columns
    shard, slot = unused("shard", names), unused("slot", names)
    index = interleaved(docs, shards, seed).select("doc_id", "source", "digest", "nth", F.col("shard").alias("to_shard"), F.col("slot").alias("to_slot"), F.col("size").alias("bytes_"))
    index = materialize(index, "shard-index")
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"))
    held = held.select("row", F.col("row.doc_id").alias("r_doc"), F.col("row.source").alias("r_source"), F.unhex(F.md5(F.coalesce("row.text", F.lit("")).cast("binary"))).alias("r_digest"))
    same = F.col("r_doc").eqNullSafe(F.col("doc_id")) & F.col("r_source").eqNullSafe(F.col("source")) & (F.col("r_digest") == F.col("digest"))
    # repeated rows take the places of their key in turn, in the order of their whole content
    repeated = index.where("nth = 1").select("doc_id", "source", "digest")
    single = held.join(repeated, same, "left_anti").withColumn("r_nth", F.lit(0).cast("long"))
    order = Window.partitionBy("r_doc", "r_source", "r_digest").orderBy(F.to_json("row"))
    several = held.join(repeated, same, "left_semi").withColumn("r_nth", (F.row_number().over(order) - 1).cast("long"))
    placed = single.unionByName(several).join(index, same & (F.col("r_nth") == F.col("nth"))).select("row", "to_shard", "to_slot")
    out = placed.repartitionByRange("to_shard", "to_slot").sortWithinPartitions("to_shard", "to_slot")
    out = out.select("row.*", F.col("to_shard").alias(shard), F.col("to_slot").alias(slot))
    out.write.partitionBy(shard).parquet(path)
    per = index.groupBy("to_shard", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes_").alias("bytes"))
    return per.groupBy(F.col("to_shard").alias("shard")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("sources"))


def read_shard(spark: SparkSession, path: str, shard: int, names: list[str]) -> DataFrame:
    """The documents of one shard of ``write_shards``, with their slots; ``names`` are the documents' own columns."""
    return spark.read.parquet(f"{path}/{unused('shard', names)}={shard}").orderBy(unused("slot", names))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the shard and slot of every document."""
    rows = interleaved(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = r"""
WITH light AS (
  SELECT doc_id, source, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
         ('0x' || left(md5('shard-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 15))::BIGINT AS draw
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
         ('0x' || left(md5('shard-1:' || coalesce(source, chr(0) || 'null')), 8))::BIGINT / 4294967296.0::DOUBLE AS phase
  FROM light),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + phase) / n, encode(source) NULLS LAST, rank) - 1 AS place, count(*) OVER () AS total FROM ranked),
table_of AS (
  SELECT list(list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS t
  FROM range(256) AS r(i)),
cut AS (SELECT *, place * 24 // total AS shard FROM placed)
SELECT doc_id, size,
       xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT),
           lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, shard::INTEGER AS shard, (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut, table_of
"""
