"""Secret scans with corpus-wide ownership frequency (native).

Every whole text is scanned by one regular expression per kind. Matches and
their places come from two functions of the same expression: all matches, and
the text between them; a running sum of their lengths gives the spans. The sum
goes chunk by chunk, so a text with very many matches takes time in proportion
to them.

Each candidate value is hashed, and the hashes are counted over the corpus by
distinct repositories and owners (here: documents and sources). A value that
several owners hold in several repositories is a widely copied example; any
other looks like a live credential of its owner. Equal (hash, owner,
repository) rows are summed up first, so a value that a third of all documents
hold is spread over its documents until only counts are left. The verdict goes
back to the documents by hash: the few values that make up more than a fixed
share of all spans are sent to all tasks, so what is joined by shuffle has no
large group. Texts
are read once and never shuffled: what goes on is one row per document with
its spans, written to the shared folder.

Only DataFrame functions are used.

Defined results: null text is empty; null repositories, and null owners, count
as one; rows with the same doc_id are scanned one by one; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hex_digest, join_counted, materialize

#: The patterns by kind, in listed order. In `assign` the whole
#: statement is the match and group 2 the value; short values are dropped afterwards,
#: as a short match still uses up its text.
BASE_KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
#: Kinds that the method adds to the base ones.
MORE_KINDS = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
KINDS = BASE_KINDS | MORE_KINDS
MIN_VALUE = 12
#: Owners and repositories from which on, both together, a value counts as widely copied.
SHARED_OWNERS, SHARED_REPOSITORIES = 2, 3
#: Matches of one text whose places are summed in one go.
CHUNK = 256

_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,value:string>"


def _spans(text: Column, kind: str, pattern: str, rank: int) -> Column:
    """All leftmost non-overlapping matches of one kind as an array of spans."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    none = F.array().cast(f"array<{_SPAN}>")
    # there is one gap more than hits: the last one has no hit and is left out
    zipped = F.arrays_zip(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))).alias("gap"), found.alias("hit"), value.alias("value"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.char_length(m["gap"])
        end = begin + F.char_length(m["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span.cast(_SPAN))).alias("out"))

    def chunk(hits: Column, first: Column) -> Column:
        """The spans of one chunk, counted from its own beginning, and its length."""
        return F.aggregate(F.slice(hits, first, F.lit(CHUNK)), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")).cast(_SPAN)

    def join(acc: Column, c: Column) -> Column:
        here = F.array(F.transform(c["out"], lambda s: moved(s, acc["at"]))).cast(f"array<array<{_SPAN}>>")
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], here).alias("out"))

    # within a function of an array its elements are at hand, while what stands outside would be worked out again for each of them
    cut = lambda hits: F.transform(F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(CHUNK)), lambda first: chunk(hits, first))
    chunks = F.element_at(F.transform(F.array(zipped), cut), 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    spans = F.flatten(F.aggregate(chunks, start, join, lambda acc: acc["out"]))
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= MIN_VALUE)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, repository, owner, spans (start, rank, kind, end, value; by start, then kind): one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[_spans(text, kind, pattern, k) for k, (kind, pattern) in enumerate(KINDS.items())])
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias
    return docs.select("doc_id", named(repository)("repository"), named(owner)("owner"), F.array_sort(every).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Values over the corpus: value_hash, n_repositories, n_owners, n_spans, status."""
    each = found.select("repository", "owner", F.explode("spans").alias("s")).select("repository", "owner", F.sha2("s.value", 256).alias("value_hash"))
    per = each.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    counted = per.groupBy("value_hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n_spans"))
    shared = (F.col("n_owners") >= SHARED_OWNERS) & (F.col("n_repositories") >= SHARED_REPOSITORIES)
    return counted.withColumn("status", F.when(shared, "example").otherwise("live"))


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, spans, n_live, n_example: every span of the document and how many of
    its values look live or are widely copied."""
    found = materialize(scan(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    status = materialize(ownership(found).select("value_hash", "n_spans", "status"), "secret-status")
    total = status.agg(F.sum("n_spans")).first()[0] or 0
    each = found.select("row", F.explode("spans").alias("s")).select("row", F.sha2("s.value", 256).alias("value_hash"))
    judged = join_counted(each, status, "value_hash", "n_spans", total).groupBy("row")
    judged = judged.agg(F.count_if(F.col("status") == "live").alias("n_live"), F.count_if(F.col("status") == "example").alias("n_example"))
    return found.join(judged, "row", "left").select("doc_id", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: base counts and digest, all spans, and the ownership counts."""
    done = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return done.select("doc_id", *map(count, BASE_KINDS), hex_digest(_listed(base)).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_MATCHES = " UNION ALL ".join(
    f"SELECT row, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, {_quoted(p)}, 0) AS hits, "
    f"regexp_extract_all(text, {_quoted(p)}, {2 if kind == 'assign' else 0}) AS vals, string_split_regex(text, {_quoted(p)}) AS gaps FROM d"
    for rank, (kind, p) in enumerate(KINDS.items())
)
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
m AS ({_MATCHES}),
u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (
  SELECT row, kind, rank, vals[i] AS v, length(hits[i]) AS n,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS st
  FROM u),
k AS (SELECT *, kind || ':' || st::BIGINT || ':' || (st + n)::BIGINT AS listed FROM s WHERE kind <> 'assign' OR length(v) >= {MIN_VALUE}),
own AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) >= {SHARED_OWNERS} AND count(DISTINCT coalesce(doc_id::VARCHAR, chr(0))) >= {SHARED_REPOSITORIES} AS shared
  FROM k JOIN d USING (row) GROUP BY v),
j AS (SELECT k.*, shared FROM k JOIN own USING (v))
SELECT any_value(d.doc_id) AS doc_id,
       count(*) FILTER (WHERE kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 'access')::BIGINT AS n_access, count(*) FILTER (WHERE kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(listed, ',' ORDER BY st, rank) FILTER (WHERE rank < {len(BASE_KINDS)}), '')) AS base_sha256,
       coalesce(string_agg(listed, ',' ORDER BY st, rank), '') AS spans,
       count(*) FILTER (WHERE NOT shared)::BIGINT AS n_live, count(*) FILTER (WHERE shared)::BIGINT AS n_example
FROM d LEFT JOIN j USING (row) GROUP BY row
"""
