"""Mixing sources to target weights by systematic sampling.

Targets: the words of all documents are shared among the sources by weight;
no source's target passes ``cap`` times its own size, and what is cut off is
shared again by weight among the others. Water-filling gives that in one pass:
sources are ordered by cap per unit of weight, and running sums tell how many
of them are capped.

Sampling: within a source every document expects ``target / source_size``
copies. Documents are ranked by falling size (ties by doc_id and text), the
expected copies are prefix-summed along that order, a seeded random offset in
[0, 1) is added once per source, and a document is emitted once per integer
that the running sum crosses. As neighbours in that order are of like size,
the words taken stay near the target.

The rank needs no sort of a whole source: rows are counted by (source, size,
salt), the counts are prefix-summed, and rows are numbered within such a cell
only, so a source with a third of all rows is dealt over many tasks.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; sources of size 0 have target 0 and take nothing; repeated rows
are sampled one by one; an empty table gives an empty result; extra columns
pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_side, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Rows of one (source, size) cell that are numbered in one group.
CELL_ROWS = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """(source, size) rows -> source, source_size, weight, target, offset.

    One row per source: the windows run over that small table.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    alone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # ratio of cap to weight as integers: compare size * (product of weights) / weight
    scale = 1
    for w in set(weights):
        scale *= w
    per = per.withColumn("ratio", F.expr(f"source_size * {cap} * {scale} div weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(alone).alias("total"),
        F.sum("weight").over(alone).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    # what a unit of weight gets if every source before this one is capped and no other is
    level = (F.lit(share) * F.col("total") - cap * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    # the first uncapped source in that order fixes the level of all the uncapped ones
    water = F.max(F.when(~F.col("capped"), F.struct(-F.col("ratio"), F.col("level").alias("level")))).over(alone)["level"]
    target = F.when(F.col("capped"), cap * F.col("source_size").cast("double")).otherwise(F.col("weight") * water)
    seed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("source"), F.lit("\u0000null"))), 256)
    offset = F.conv(F.substring(seed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return per.select("source", "source_size", "weight", target.alias("target"), offset.alias("offset"))


def sampled_copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """docs -> doc_id, source, size, source_size, target, copies: one light row per document row."""
    light = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes"
    )
    targets = source_targets(light, weights, cap, share)
    cells = light.groupBy("source", "size").count()
    # cells with more rows than CELL_ROWS are numbered in several parts, cut by hash
    parts = cells.withColumn("parts", F.ceil(F.col("count") / CELL_ROWS)).where("parts > 1").select("source", "size", "parts")
    salted = light.join(
        small_side(parts.withColumnsRenamed({"source": "c_source", "size": "c_size"})),
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")),
        "left",
    ).select("doc_id", "source", "size", "tie", F.pmod(F.xxhash64("doc_id", "tie"), F.coalesce("parts", F.lit(1))).alias("salt"))
    inner = Window.partitionBy("source", "size", "salt").orderBy("doc_id", "tie")
    ranked = salted.withColumn("nth", F.row_number().over(inner))
    # rows before each cell: first within its size (salts), then over the sizes of the source
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc(), "salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy("source", "size", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", "size", "salt", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("before"))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.col("source").alias("b_source"),
            F.col("size").alias("b_size"),
            F.col("salt").alias("b_salt"),
            "before",
            "source_size",
            "target",
            "offset",
        )
    )
    near = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("salt") == F.col("b_salt"))
    joined = ranked.join(base, near)
    rank = F.col("before") + F.col("nth")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rank * rate + F.col("offset")) - F.floor((rank - 1) * rate + F.col("offset"))
    return joined.select("doc_id", "source", "size", "tie", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as it was drawn, columns unchanged."""
    drawn = (
        sampled_copies(docs, weights, cap, share)
        .groupBy("doc_id", "source", "tie")
        # equal rows share a key: all their copies together
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
        .where("copies > 0")
    )
    # a whole row is one column here, so none of its names meets one of ours
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    near = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.xxhash64("row.text") == F.col("tie"))
    joined = held.join(small_side(drawn), near)
    # a key with several equal rows has its copies dealt over them; the first ones get the rest
    single = joined.where("rows = 1").select("row", F.col("copies").alias("times"))
    several = joined.where("rows > 1").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy(F.lit(1))))
    more = F.when(F.col("nth") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    several = several.select("row", (F.expr("copies div rows") + more).alias("times"))
    out = single.unionByName(several).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = sampled_copies(docs)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH light AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM light GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM per),
r AS (SELECT *, source_size * 3 * 10 // weight AS ratio FROM w),
b AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS all_weight,
         coalesce(sum(source_size) OVER before, 0)::BIGINT AS size_before,
         coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before
  FROM r WINDOW before AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total::DOUBLE - 3 * size_before) / (all_weight - weight_before) AS level FROM b),
c AS (SELECT *, level * weight >= 3 * source_size AS capped FROM l),
water AS (SELECT arg_min(level, ratio) AS water FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 3 * source_size::DOUBLE ELSE weight * water END AS target,
         ('0x' || substr(sha256('mix-1:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS offs
  FROM c LEFT JOIN water ON true),
k AS (
  SELECT doc_id, size, source_size, target, offs,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY light.source ORDER BY size DESC, doc_id) AS rank
  FROM light JOIN t ON light.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rank * rate + offs) - floor((rank - 1) * rate + offs)))::BIGINT AS taken
FROM k
"""
