"""Transcript files as tables: one row per JSON line with its 1-based line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .lines import read_lines


def scan_transcripts(spark: SparkSession, globs: list[str], modified_after: str | None = None, split: int | None = None) -> DataFrame:
    """Path, mtime, size, line_no, raw from one scan; blank lines are counted, but not returned."""
    return read_lines(spark, globs, modified_after, split)


def union_roots(frames: list[DataFrame]) -> DataFrame:
    """Several roots; a file that two of them reach is read once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["path", "line_no"])


def parse_tolerant(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Adds v (VARIANT); lines that are no JSON go. ``counts`` gets the numbers ``lines`` and ``malformed`` from the
    same pass, to be read after the action."""
    parsed = lines.withColumn("v", F.try_parse_json("raw"))
    if counts is not None:
        parsed = parsed.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("v").isNull()).alias("malformed"))
    return parsed.where("v is not null")


def malformed_lines(lines: DataFrame) -> DataFrame:
    """P4, by file: path, lines, malformed."""
    bad = F.count_if(F.try_parse_json("raw").isNull())
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), bad.alias("malformed"))


#: Fixed value: columns of a session's rate-limit log.
RATELIMIT_SCHEMA = "ts string, pct_5h double, reset_5h long, pct_7d double, reset_7d long, alert string, version string"


def read_ratelimit_log(spark: SparkSession, globs: list[str], counts: Observation | None = None) -> DataFrame:
    """The sessions' rate-limit logs (CSV, one file a session), resets filled in; ``line`` is the file's own line.

    Lines that are no reading go: ``counts`` gets ``lines`` and ``malformed``, headers being neither.
    """
    read = read_lines(spark, globs).where("not startswith(raw, 'ts,')")
    row = F.from_csv("raw", RATELIMIT_SCHEMA + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    read = read.withColumn("row", row).withColumn("at", F.unix_timestamp(F.try_to_timestamp("row.ts")))
    broken = F.col("row.bad").isNotNull() | F.col("at").isNull()
    if counts is not None:
        read = read.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(broken).alias("malformed"))
    sid = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    log = read.where(~broken).select(sid.alias("sid"), F.col("at").alias("ts_s"), F.col("line_no").alias("line"), *[f"row.{c}" for c in ("pct_5h", "reset_5h", "pct_7d", "reset_7d", "alert", "version")])
    return dense_log(log)


def dense_log(log: DataFrame, columns: tuple[str, ...] = ("reset_5h", "reset_7d")) -> DataFrame:
    """Resets are written only where they change; here each reading bears the one in force."""
    order = Window.partitionBy("sid").orderBy("ts_s", "line").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns})


def path_dims(path: Column) -> dict[str, Column]:
    """S3: project (after the last ``/projects/``), agent and parent session of a file's path."""
    tail = F.element_at(F.split(path, "/projects/"), -1)
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    workflow = F.regexp_extract(path, r"/workflows/([^/]+)/", 1)
    is_agent = stem.startswith("agent-")
    own = F.when(is_agent, F.regexp_replace(stem, "^agent-", "")).otherwise(stem)
    return {
        "project": F.when(path.contains("/projects/"), F.regexp_extract(tail, "^([^/]+)", 1)),
        "is_agent": is_agent,
        "agent_id": F.when(is_agent, F.when(workflow != "", F.concat(workflow, F.lit("-"), own)).otherwise(own)),
        "parent": F.when(is_agent, F.regexp_extract(path, r"/([^/]+)/subagents/", 1)),
        "sid": F.when(is_agent, F.concat(F.lit("agent-"), own)).otherwise(own),
    }


def with_path_dims(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumns(path_dims(F.col(path)))


def drop_orphan_agents(files: DataFrame) -> DataFrame:
    """An agent's file counts only if its main session's file is there."""
    mains = files.where("not is_agent").select(F.col("project").alias("m_project"), F.col("sid").alias("m_sid")).distinct()
    agents = files.where("is_agent").join(mains, (F.col("project") == F.col("m_project")) & (F.col("parent") == F.col("m_sid")), "left_semi")
    return files.where("not is_agent").unionByName(agents)


def drop_workflow_journals(files: DataFrame, path: str = "path") -> DataFrame:
    """S5."""
    return files.where(~F.col(path).rlike(r"/workflows/[^/]+/journal\.jsonl$"))


def content_text(v: Column) -> Column:
    """P5: the text of a message's content: a string, or the text blocks of a list."""
    blocks = F.try_variant_get(v, "$.message.content", "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    plain = F.try_variant_get(v, "$.message.content", "string")
    return F.when(blocks.isNotNull(), F.array_join(texts, " ")).otherwise(F.coalesce(plain, F.lit("")))


def usage_rows(parsed: DataFrame) -> DataFrame:
    """Assistant lines with usage -> ledger rows (before A1): one per streamed chunk."""
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    n = lambda path: F.coalesce(get(f"$.message.usage.{path}", "bigint"), F.lit(0))
    calls = parsed.where(get("$.type", "string") == "assistant").where(get("$.message.model", "string").isNotNull())
    return calls.select(
        *[c for c in ("path", "sid", "parent", "project") if c in parsed.columns],
        F.unix_seconds(F.try_to_timestamp(get("$.timestamp", "string"))).alias("ts_s"),
        get("$.message.model", "string").alias("model"),
        n("input_tokens").alias("input"),
        n("cache_creation_input_tokens").alias("cc"),
        get("$.message.usage.cache_creation.ephemeral_5m_input_tokens", "bigint").alias("cc5m"),
        get("$.message.usage.cache_creation.ephemeral_1h_input_tokens", "bigint").alias("cc1h"),
        n("cache_read_input_tokens").alias("cr"),
        n("output_tokens").alias("out"),
        F.col("line_no").alias("line"),
        F.coalesce(get("$.requestId", "string"), get("$.message.id", "string")).alias("req"),
    )


def codex_rollouts(parsed: DataFrame) -> DataFrame:
    """Session, thread and role from the first row of each rollout file."""
    get = lambda path: F.try_variant_get("v", path, "string")
    head = parsed.where("line_no = 1").where(get("$.type") == "session_meta")
    return head.select("path", get("$.payload.id").alias("sid"), F.coalesce(get("$.payload.session_id"), get("$.payload.id")).alias("thread"), get("$.payload.source.subagent").isNotNull().alias("is_subagent"))


def counter_rows(parsed: DataFrame) -> DataFrame:
    """Cumulative counters of rollout files, as W9 reads them."""
    kind = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>"
    get = lambda path: F.try_variant_get("v", path, kind)
    rename = lambda c: F.when(c.isNotNull(), F.struct(c["input_tokens"].alias("input"), c["cached_input_tokens"].alias("cached"), c["output_tokens"].alias("output")))
    counts = parsed.where(F.try_variant_get("v", "$.payload.type", "string") == "token_count")
    return counts.select("path", F.col("line_no").alias("line"), rename(get("$.payload.info.total_token_usage")).alias("total"), rename(get("$.payload.info.last_token_usage")).alias("last"))


def normalize_codex(parsed: DataFrame) -> DataFrame:
    """One row out for every row in, so that line numbers hold; unknown rows are placeholders."""
    get = lambda path: F.try_variant_get("v", path, "string")
    kind, inner, role = get("$.type"), get("$.payload.type"), get("$.payload.role")
    blocks = F.try_variant_get("v", "$.payload.content", "array<struct<text:string>>")
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    label = F.when((kind == "response_item") & (inner == "message") & role.isin("user", "assistant"), role).when((kind == "response_item") & inner.isin("function_call", "custom_tool_call"), "tool").when(kind == "compacted", "system").otherwise("placeholder")
    return parsed.select("path", "line_no", label.alias("role"), F.when(label.isin("user", "assistant"), text).when(label == "tool", get("$.payload.name")).alias("text"))


def changed_files(listing: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """Files that are newer than their result, or whose result is of another version."""
    same = done.where(F.col("version") == version).select("path", "mtime", "size")
    return listing.join(same, ["path", "mtime", "size"], "left_anti")


def retained_sessions(derived: DataFrame, listed: DataFrame, since_s: int) -> DataFrame:
    """Results whose sources are gone still count in their period."""
    gone = derived.join(listed.select("sid").distinct(), "sid", "left_anti").where(F.col("last_ts") >= since_s)
    return derived.join(listed.select("sid").distinct(), "sid", "left_semi").unionByName(gone)


def numbered_by_appearance(rows: DataFrame, key: str, order: str = "ts_s") -> DataFrame:
    """Numbers instead of ids, by first appearance."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return first.withColumn("number", F.row_number().over(Window.orderBy("_first", key))).drop("_first")
