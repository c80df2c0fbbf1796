"""Exports, message alignment, agents' messages, and block-wise token estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Calls by which one agent speaks to another, and the beginnings of what it is told.
DISPATCH_CALLS = ("spawn_agent", "send_message", "followup_task")
ENVELOPE = r"^\s*Message Type: (MESSAGE|FINAL_ANSWER|NEW_TASK)\b"
#: Tokens that an image or a document counts in the host's rough rule.
IMAGE_TOKENS = 2000


def est_block_tokens(v: Column, path: str = "$.message.content") -> Column:
    """rough tokens of a content value: a quarter of the characters, by block type."""
    rough = lambda text: F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4 + 0.5).cast("long")
    get = lambda b, p, kind="string": F.try_variant_get(b, p, kind)
    blocks = F.try_variant_get(v, path, "array<variant>")

    def block(b: Column) -> Column:
        kind = get(b, "$.type")
        inner = F.try_variant_get(b, "$.content", "array<struct<type:string,text:string>>")
        listed = F.aggregate(F.coalesce(inner, F.array().cast("array<struct<type:string,text:string>>")), F.lit(0).cast("long"), lambda n, x: n + F.when(x["type"] == "text", rough(x["text"])).otherwise(F.lit(IMAGE_TOKENS)))
        return (
            F.when(kind == "text", rough(get(b, "$.text")))
            .when(kind.isin("image", "document"), F.lit(IMAGE_TOKENS).cast("long"))
            .when(kind == "tool_result", F.when(inner.isNotNull(), listed).otherwise(rough(get(b, "$.content"))))
            .when(kind == "tool_use", rough(F.concat(F.coalesce(get(b, "$.name"), F.lit("")), F.coalesce(F.to_json(get(b, "$.input", "variant")), F.lit("{}")))))
            .when(kind == "thinking", rough(get(b, "$.thinking")))
            .when(kind == "redacted_thinking", rough(get(b, "$.data")))
            .otherwise(rough(F.to_json(b)))
        )

    summed = F.aggregate(F.transform(blocks, block), F.lit(0).cast("long"), lambda n, x: n + x)
    return F.when(blocks.isNotNull(), summed).otherwise(rough(F.try_variant_get(v, path, "string")))


def image_markers(v: Column, path: str = "$.message.content", most: int = 3) -> Column:
    """a mark for each image of a message, and a count of those over the cap."""
    n = F.size(F.filter(F.coalesce(F.try_variant_get(v, path, "array<struct<type:string>>"), F.array().cast("array<struct<type:string>>")), lambda b: b["type"] == "image"))
    more = F.when(n > most, F.concat(F.lit(" [+"), n - most, F.lit(" images]"))).otherwise("")
    return F.concat(F.trim(F.repeat(F.lit("[Image] "), F.least(n, F.lit(most)))), more)


def agent_messages(parsed: DataFrame) -> DataFrame:
    """Dispatches to other agents, and envelopes that came from them (recognized by their first words only)."""
    get = lambda p: F.try_variant_get("v", p, "string")
    args = F.try_parse_json(get("$.payload.arguments"))
    arg = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get(args, f"$.{n}", "string"), F.lit("")) for n in names])
    name = F.regexp_replace(get("$.payload.name"), r"^(collaboration|functions)\.", "")
    items = parsed.where(get("$.type") == "response_item")
    sent = items.where((get("$.payload.type") == "function_call") & name.isin(*DISPATCH_CALLS)).select(
        "path", "line_no", F.lit("outgoing").alias("direction"), name.alias("kind"), arg("target", "id", "to", "recipient", "task_name", "agent_type").alias("peer"), arg("message", "content", "prompt", "task").alias("text")
    )
    blocks = F.try_variant_get("v", "$.payload.content", "array<struct<text:string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    came = items.where((get("$.payload.type") == "message") & (get("$.payload.role") == "developer")).withColumn("said", said)
    came = came.where(F.col("said").rlike(ENVELOPE)).select(
        "path", "line_no", F.lit("incoming").alias("direction"), F.regexp_extract("said", ENVELOPE, 1).alias("kind"), F.lit(None).cast("string").alias("peer"), F.trim("said").alias("text")
    )
    return sent.where("text is not null").unionByName(came)


def align_messages(messages: DataFrame, rows: DataFrame, chars: int = 60) -> DataFrame:
    """The transcript line of each message: the next row of its role, after the match before it,
    whose head starts with the message's first characters.

    Candidates are joined by (session, role, first characters), which leaves a handful a message;
    the walk over one session's candidates is a grouped task.
    """
    collapse = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    keyed = messages.withColumn("key", F.substring(collapse("text"), 1, chars)).where("key <> ''")
    length = F.char_length("key")
    lengths = keyed.select("sid", length.alias("n")).distinct()
    heads = rows.withColumn("head", collapse("head")).join(lengths, "sid").where(F.char_length("head") >= F.col("n"))
    heads = heads.select(F.col("sid").alias("r_sid"), F.col("role").alias("r_role"), F.col("head").substr(F.lit(1), F.col("n")).alias("r_key"), F.col("line").alias("r_line"))
    near = (F.col("sid") == F.col("r_sid")) & (F.col("role") == F.col("r_role")) & (F.col("key") == F.col("r_key"))
    candidates = keyed.join(heads, near).groupBy("sid", "nth").agg(F.array_sort(F.collect_set("r_line")).alias("lines"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        after, out = 0, []
        for m in frame.sort_values("nth").itertuples(index=False):
            line = next((x for x in m.lines if x > after), None)
            if line is not None:
                after = line
                out.append((m.sid, m.nth, line))
        return pd.DataFrame(out, columns=["sid", "nth", "line"])

    return candidates.groupBy("sid").applyInPandas(walk, "sid string, nth long, line long")


def alert_lines(turns: DataFrame, markers: DataFrame) -> DataFrame:
    """User turns with the kinds of their markers."""
    kinds = {"@@": "clear", "++": "autocompact", "+": "compact", "~": "reload", "!": "model", "^": "continue"}
    rest, out = F.col("markers"), []
    for mark, kind in kinds.items():
        out.append(F.when(rest.contains(mark), kind))
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    start = F.when(rest.contains("@"), "start")
    return turns.join(markers, ["sid", "turn"]).withColumn("kinds", F.array_join(F.array_compact(F.array(*out, start)), "+"))


def write_window_exports(rows: DataFrame, path: str, ids: list[str], account: str = "account") -> dict[str, DataFrame]:
    """One folder of CSV a window, ids replaced by numbers of first appearance; returns and writes the number tables."""
    out, numbers = rows, {}
    for c in ids:
        first = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct("ts_s", "line")).alias("_first"))
        # one row an id: the numbering runs over this small table
        table = first.withColumn("number", F.row_number().over(Window.orderBy("_first", c))).select(c, "number")
        numbers[c] = table
        table.write.mode("overwrite").parquet(f"{path}/numbers_{c}")
        out = out.join(table, c, "left").drop(c).withColumnRenamed("number", c)
    out.write.mode("overwrite").partitionBy(account, "win").option("header", True).csv(f"{path}/windows")
    return numbers


def write_report_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """The result tables of a report side by side."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(form).save(f"{path}/{name}")


def credit_card(raw: DataFrame) -> tuple[DataFrame, dict]:
    """A credit card file (models: array of id, fresh, cached, output; meta.creditsPerUsd) with its checks: flags, never an error."""
    card = raw.select(F.explode("models").alias("m")).select(F.col("m.id").alias("id"), *[F.col(f"m.{c}").cast("double").alias(c) for c in ("fresh", "cached", "output")])
    bad = F.count_if((F.col("fresh") < 0) | (F.col("cached") < 0) | (F.col("output") < 0) | F.col("id").isNull())
    checks = card.agg((F.count("id") - F.count_distinct("id")).alias("duplicates"), bad.alias("bad_rates")).first()
    divisor = raw.select(F.col("meta.creditsPerUsd").cast("double")).first()[0]
    ok = divisor is not None and 0 < divisor < float("inf") and not checks["duplicates"] and not checks["bad_rates"]
    return card, {"valid": ok, "credits_per_usd": divisor, "duplicates": checks["duplicates"], "bad_rates": checks["bad_rates"]}


def agent_meta(spark, globs: list[str]) -> DataFrame:
    """The agents' side files: path, agent_type, description."""
    raw = spark.read.schema("agentType string, description string").option("multiLine", True).json(globs)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("agentType").alias("agent_type"), "description")
