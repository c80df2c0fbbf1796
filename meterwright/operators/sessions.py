"""Sessions, listings, markers, restores and studies on top of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..sources.committed import committed
from .ledger import all_tokens
from .restore import marked_transcripts, restore_sections, verbatim_tail  # noqa: F401


def list_sessions(sessions: DataFrame, limit: int = 10, offset: int = 0, exclude: list[str] = (), source: str | None = None) -> DataFrame:
    """O1: newest first; ties by id."""
    kept = sessions.where(~F.col("sid").isin(list(exclude))) if exclude else sessions
    if source:
        kept = kept.where(F.col("source") == source)
    return kept.orderBy(F.desc("last_ts"), "sid").offset(offset).limit(limit)


def current_session(sessions: DataFrame, now_s: int) -> DataFrame:
    """O2: the session with the youngest last message."""
    return sessions.where(F.col("last_ts") <= now_s).agg(F.max_by("sid", F.struct("last_ts", "sid")).alias("sid"), F.min(now_s - F.col("last_ts")).alias("age"))


def session_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Within a window main sessions, then batches, then programmatic ones; dearest first."""
    rank = F.when(F.col("type") == "main", 0).when(F.col("type") == "batch", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.desc("cost_e8"), "sid")))


def scope_project(rows: DataFrame, name: str, column: str = "project") -> DataFrame:
    """The rows of one project."""
    return rows.where(F.col(column) == name)


def host_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """U4: sessions that both hosts claim; empty if all is well."""
    return first.select("sid").intersect(second.select("sid"))


def drop_non_interactive(sessions: DataFrame, current: str | None = None) -> DataFrame:
    """P10: sessions of a program's entry point go, the current one never."""
    return sessions.where((F.col("entrypoint").isNull() | ~F.col("entrypoint").isin("sdk", "sdk-cli", "sdk-py", "sdk-ts")) | F.col("sid").eqNullSafe(F.lit(current)))


def drop_restore_sessions(sessions: DataFrame, mark: str) -> DataFrame:
    """By the skill's signature."""
    return sessions.where(~F.coalesce(F.col("skill_signature").contains(mark), F.lit(False)))


def drop_sidechain(lines: DataFrame) -> DataFrame:
    """P14."""
    return lines.where(~F.coalesce("is_sidechain", F.lit(False)))


def classify_record(kind: Column, is_meta: Column, text: Column, is_tool_result: Column) -> Column:
    """Who speaks in a record, or null."""
    return (
        F.when((kind == "user") & is_tool_result, None)
        .when((kind == "user") & text.contains("<teammate-message"), "Teammate")
        .when((kind == "user") & text.contains("<task-notification>"), "Agent")
        .when((kind == "user") & (F.coalesce(is_meta, F.lit(False)) | P.is_machine_prompt(text)), "Machine")
        .when(kind == "user", "User")
        .when((kind == "assistant") & (S.stripped(text) != ""), "Assistant")
        .when(kind == "system", "System")
    )


def first_and_last_message(lines: DataFrame) -> DataFrame:
    """First and last genuine user text of each session; bare commands do not count."""
    said = lines.where("role = 'user'").withColumn("clean", S.strip_tags(F.col("text")))
    said = said.where(P.is_genuine_user(F.col("clean")) & ~F.col("clean").rlike(r"^/[\w:-]+$|^<command-name>"))
    return said.groupBy("sid").agg(F.min_by("clean", "line").alias("first_text"), F.max_by("clean", "line").alias("last_text"), F.count(F.lit(1)).alias("messages"))


def parent_link(sessions: DataFrame) -> DataFrame:
    """A parent is what the path proves; a shared thread is a hint, never a parent."""
    mains = sessions.where("parent is null").select(F.col("sid").alias("_main")).distinct()
    joined = sessions.join(mains, F.col("parent") == F.col("_main"), "left")
    return joined.withColumn("orphan", F.col("parent").isNotNull() & F.col("_main").isNull()).drop("_main")


def session_project(sessions: DataFrame, paths: DataFrame, listing: DataFrame) -> DataFrame:
    """The transcript's path beats the directory listing."""
    a = paths.select("sid", F.col("project").alias("path_project"))
    b = listing.select("sid", F.col("project").alias("listing_project"))
    return sessions.join(a, "sid", "left").join(b, "sid", "left").withColumn("project", F.coalesce("path_project", "listing_project"))


def window_messages(messages: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last user text inside each window; windows of one key do not overlap."""
    from .windows import assign_stated_window

    held = assign_stated_window(messages, windows, keys).where("win is not null")
    at = F.struct("ts_s", "line")
    return held.groupBy(*keys, "win").agg(F.min_by("text", at).alias("first_text"), F.max_by("text", at).alias("last_text"), F.count(F.lit(1)).alias("messages"))


def alerts_in_window(alerts: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts of each window by type."""
    from .windows import assign_stated_window

    return assign_stated_window(alerts, windows, keys).where("win is not null").groupBy(*keys, "win", "alert").agg(F.count(F.lit(1)).alias("n"))


def blocked_samples(samples: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Samples at 100 % and when the first one came, per window."""
    from .windows import assign_stated_window

    held = assign_stated_window(samples, windows, keys).where("win is not null")
    return held.groupBy(*keys, "win").agg(F.count_if(F.col("used_percent") >= 100).alias("blocked"), F.min(F.when(F.col("used_percent") >= 100, F.col("ts_s"))).alias("first_blocked"))


def restored_context(restores: DataFrame, rows: DataFrame) -> DataFrame:
    """(restore, read: array of sessions): the last cache read of each restored session, added up."""
    last = rows.where("cr > 0").groupBy("sid").agg(F.max_by("cr", F.struct("ts_s", "line")).alias("context"))
    each = restores.select("restore", F.explode(F.array_distinct("read")).alias("sid"))
    return each.join(last, "sid", "left").groupBy("restore").agg(F.coalesce(F.sum("context"), F.lit(0)).alias("context"))


def restore_savings(contexts: DataFrame, rates: DataFrame) -> DataFrame:
    """The summary call that a restore avoids: context read (best) or written for an hour (worst), and a tenth as output."""
    r = contexts.crossJoin(F.broadcast(rates))  # one row of rates
    out = F.floor(F.col("context") / 10) * F.col("r_out")
    return r.select("restore", (F.col("context") * F.col("r_cr") + out).cast("long").alias("best_e8"), (F.col("context") * F.col("r_cc1h") + out).cast("long").alias("worst_e8"))


def compact_agent_aggregate(rows: DataFrame) -> DataFrame:
    """Per parent and compaction agent: context of its first call, and totals."""
    agents = rows.where(P.is_compact_agent(F.col("sid")))
    return agents.groupBy("parent", "sid").agg(F.min_by(F.col("input") + F.col("cc") + F.col("cr"), F.struct("ts_s", "line")).alias("context"), F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def programmatic_bundle(rows: DataFrame, programmatic: DataFrame, keys: list[str]) -> DataFrame:
    """What programs' sessions used in each window."""
    kept = rows.join(programmatic.where("programmatic").select("sid"), "sid", "left_semi")
    return kept.groupBy(*keys, "win").agg(F.count_distinct("sid").alias("sessions"), F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"))


def period_overview(rows: DataFrame) -> DataFrame:
    """A43."""
    return rows.groupBy("host").agg(F.sum(all_tokens()).alias("tokens"), F.count_distinct("sid").alias("sessions"), F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"))


def usage_highlights(rows: DataFrame) -> DataFrame:
    """Busiest hour, busiest weekday and dearest day, from one sub-aggregate by hour."""
    cell = rows.groupBy(F.floor(F.col("ts_s") / 3600).alias("h")).agg(F.sum("cost_e8").alias("v"))
    best = lambda key: cell.groupBy(key.alias("k")).agg(F.sum("v").alias("v")).agg(F.max_by("k", F.struct("v", -F.col("k"))).alias("k"), F.max("v").alias("v"))
    day = F.floor(F.col("h") / 24)
    named = [("busiest_hour", F.col("h") % 24), ("busiest_weekday", (day + 4) % 7), ("peak_day", day)]
    out = None
    for name, key in named:
        one = best(key).select(F.lit(name).alias("what"), F.col("k").cast("long").alias("which"), F.col("v").alias("cost_e8"))
        out = one if out is None else out.unionByName(one)
    return out


def fill_effort(lines: DataFrame) -> DataFrame:
    """The effort level that the latest command output told."""
    told = F.regexp_extract("text", r"(?i)effort level (?:set )?to (\w+)", 1)
    order = Window.partitionBy("sid").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("effort", F.last(F.when(told != "", F.lower(told)), ignorenulls=True).over(order))


def context_loss_events(lines: DataFrame) -> DataFrame:
    """Lines where the context was cleared or compacted, and the last one."""
    command = P.slash_command(F.col("text"))
    kind = F.when(command == "clear", "clear").when(F.col("role") == "system", "compact")
    marked = lines.withColumn("event", kind).where("event is not null")
    return marked.groupBy("sid").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.max_by("event", "line").alias("last_event"), F.max("line").alias("last_line"))


def stack_markers(lines: DataFrame) -> DataFrame:
    """Markers wait for the next genuine user turn and are folded onto it in order: a clear mark goes first,
    an automatic compaction upgrades a manual one before it, others are added once, a start mark only alone."""
    order = Window.partitionBy("sid").orderBy("line")
    back = Window.partitionBy("sid").orderBy(F.desc("line"))
    turn = F.last(F.when(F.col("is_turn"), F.col("line")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    pending = lines.withColumn("turn", turn).where("marker is not null and turn is not null")
    folded = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "marker"))), lambda x: x["marker"]),
        F.lit(""),
        lambda acc, m: F.when(m == "@@", F.concat(m, F.replace(acc, F.lit("@@"), F.lit(""))))
        .when((m == "++") & acc.endswith("+") & ~acc.endswith("++"), F.concat(acc, F.lit("+")))
        .when(m == "@", F.when(acc == "", m).otherwise(acc))
        .when(acc.contains(m), acc)
        .otherwise(F.concat(acc, m)),
    )
    return pending.groupBy("sid", "turn").agg(folded.alias("markers"))


def restore_sequences(lines: DataFrame) -> DataFrame:
    """A restore command and the sessions that the reads after it name, until another reply comes."""
    order = Window.partitionBy("sid").orderBy("line")
    group = F.sum((F.col("kind") == "restore").cast("int")).over(order)
    stop = F.sum((F.col("kind") == "reply").cast("int")).over(Window.partitionBy("sid", "grp").orderBy("line"))
    inside = lines.withColumn("grp", group).where("grp > 0").withColumn("stops", stop).where("stops = 0")
    return inside.groupBy("sid", "grp").agg(F.min("line").alias("restore"), F.array_sort(F.collect_set(F.when(F.col("kind") == "read", F.col("target")))).alias("read")).drop("grp")


def named_sessions(texts: DataFrame, sessions: DataFrame, k: int = 5) -> DataFrame:
    """Earlier sessions that a session's text names by id or its first eight characters, newest k."""
    ids = texts.select("sid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){0,3}(?:-[0-9a-f]{12})?\b"), F.lit(0)))).alias("name"))
    ids = ids.select("sid", F.substring("name", 1, 8).alias("short")).distinct()
    other = sessions.select(F.col("sid").alias("named"), F.substring("sid", 1, 8).alias("short"), F.col("last_ts").alias("ended"))
    own = sessions.select("sid", "first_ts")
    found = ids.join(other, "short").join(own, "sid").where("ended < first_ts and named <> sid")
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("ended"), "named"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("sid", "named", "rank")


def nearest_tag(samples: DataFrame) -> DataFrame:
    """A missing tag is taken from the nearest tagged sample of the session, the earlier one on a tie."""
    order = Window.partitionBy("sid").orderBy("ts_s", "line")
    tagged = F.when(F.col("tag").isNotNull(), F.struct("ts_s", "tag"))
    both = samples.withColumns({"_b": F.last(tagged, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first(tagged, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    ahead = F.col("_b").isNull() | (F.col("_a.ts_s") - F.col("ts_s") < F.col("ts_s") - F.col("_b.ts_s"))
    return both.withColumn("tag", F.when(F.col("_a").isNotNull() & ahead, F.col("_a.tag")).otherwise(F.col("_b.tag"))).drop("_a", "_b")


def qualified_windows(samples: DataFrame, least_5h: float = 10, least_7d: float = 1) -> DataFrame:
    """Per reset window the session with most readings, if both readings never fall and rise enough."""
    order = Window.partitionBy("win", "sid").orderBy("ts_s", "line")
    fell = (F.col("pct_5h") < F.lag("pct_5h").over(order)) | (F.col("pct_7d") < F.lag("pct_7d").over(order))
    per = samples.withColumn("fell", F.coalesce(fell, F.lit(False))).groupBy("win", "sid").agg(
        F.max("fell").alias("fell"), (F.max("pct_5h") - F.min("pct_5h")).alias("rise_5h"), (F.max("pct_7d") - F.min("pct_7d")).alias("rise_7d"), F.count(F.lit(1)).alias("n")
    )
    good = per.where(~F.col("fell") & (F.col("rise_5h") >= least_5h) & (F.col("rise_7d") >= least_7d))
    best = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("n"), "sid"))
    return good.withColumn("_nth", best).where("_nth = 1").drop("_nth", "fell")


def jump_study(rows: DataFrame, samples: DataFrame, key: str, least_write: int = 10_000, after: tuple[int, int] = (180, 1800)) -> DataFrame:
    """The greatest reading 3 to 30 minutes after each large cache write, with the calls in that span.

    Time is cut into blocks as long as the span, so that a span is the end of one block and the beginning of the next: a running
    value from either side answers it, and no row of a span is read again for another span. A block of a key has one row a second;
    the highest reading before a block is carried over from the blocks. Writes without a key or a time meet nothing.
    """
    width = after[1] - after[0] + 1
    block = lambda t: F.floor(F.col(t) / width)
    calls = committed(rows.select(key, "ts_s", "line", "cc"), "calls")
    none = F.lit(None).cast("double").alias("most")
    both = calls.select(key, "ts_s", none, F.lit(1).alias("calls"), (F.col("cc") >= least_write).alias("large"))
    both = both.unionByName(samples.select(key, "ts_s", F.col("used_percent").alias("most"), F.lit(0).alias("calls"), F.lit(False).alias("large")))
    seconds = both.where(F.col(key).isNotNull() & F.col("ts_s").isNotNull()).groupBy(key, "ts_s").agg(F.max("most").alias("most"), F.sum("calls").alias("calls"), F.max("large").alias("large"))
    seconds = committed(seconds, "seconds")
    # a second with a large write also asks at the first and the last second of its span, unless the span is one whole block
    ask = lambda side, shift: F.struct(F.lit(side).alias("side"), (F.col("ts_s") + shift).alias("at"), none, F.lit(0).cast("long").alias("calls"))
    own = F.struct(F.lit("own").alias("side"), F.col("ts_s").alias("at"), "most", "calls")
    split = F.pmod(F.col("ts_s") + after[0], F.lit(width)) != 0
    each = F.array_compact(F.array(own, F.when(F.col("large"), ask("first", after[0])), F.when(F.col("large") & split, ask("last", after[1]))))
    marks = seconds.select(key, F.col("ts_s").alias("asked"), "large", F.explode(each).alias("x")).select(key, "asked", "large", "x.*").withColumn("block", block("at"))
    upto, since = (Window.partitionBy(key, "block").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    marks = marks.withColumns({"_upto": F.max("most").over(upto), "_calls_upto": F.sum("calls").over(upto), "_since": F.max("most").over(since), "_calls_since": F.sum("calls").over(since)})
    side = lambda name, c: F.when(F.col("side") == name, F.col(c))
    found = marks.where("large").groupBy(key, F.col("asked").alias("ts_s")).agg(
        F.max(F.coalesce(side("first", "_since"), side("last", "_upto"))).alias("most"),
        F.sum(F.coalesce(side("first", "_calls_since"), side("last", "_calls_upto"))).alias("other_calls"),
        F.max(side("own", "_upto")).alias("top"),
    )
    # one row a block of a key goes through this window
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = seconds.groupBy(key, block("ts_s").alias("block")).agg(F.max("most").alias("most")).select(key, "block", F.max("most").over(earlier).alias("carried"))
    found = found.withColumn("block", block("ts_s")).join(carried, [key, "block"], "left")
    found = found.select(key, "ts_s", (F.col("most") - F.greatest("top", "carried")).alias("rise"), "other_calls")
    large = calls.where(F.col("cc") >= least_write).join(found, [key, "ts_s"], "left")
    return large.select(key, "ts_s", "line", "cc", "rise", F.coalesce("other_calls", F.lit(0)).cast("long").alias("other_calls"))


def context_size(lines: DataFrame) -> DataFrame:
    """Usage of a session's last response plus an estimate of what came after its first row."""
    last = lines.where("usage is not null").groupBy("sid", "req").agg(F.max_by("usage", "line").alias("usage"), F.min("line").alias("anchor"), F.max("line").alias("end"))
    last = last.groupBy("sid").agg(F.max_by(F.struct("usage", "anchor"), "end").alias("l")).select("sid", "l.usage", "l.anchor")
    later = lines.join(last.select("sid", "anchor"), "sid").where((F.col("line") > F.col("anchor")) & F.col("usage").isNull()).groupBy("sid").agg(F.sum("estimate").alias("estimate"))
    return last.join(later, "sid", "left").select("sid", (F.col("usage") + F.coalesce("estimate", F.lit(0))).alias("context"))


def observed_threshold(compactions: DataFrame, idle_s: int = 2700) -> DataFrame:
    """Per model the size of the newest automatic compaction under 95 % of the computed threshold; one at or past it clears
    the entry; compactions after a quiet time do not count."""
    busy = compactions.where(F.coalesce(F.col("quiet_s") < idle_s, F.lit(True)))
    under = F.when(F.col("size") < 0.95 * F.col("threshold"), F.col("size"))
    return busy.groupBy("model").agg(F.max_by(F.struct(under.alias("size")), F.struct("ts_s", "size")).alias("n")).select("model", F.col("n.size").alias("size")).where("size is not null")


def interval_usage(rows: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Token sums of each burn interval; intervals of one key do not overlap."""
    from .windows import assign_stated_window

    held = assign_stated_window(rows, intervals, keys).where("win is not null")
    return held.groupBy(*keys, "win").agg(F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def controlled_rate(windows: DataFrame) -> DataFrame:
    """M5: what is left of a rise after the known share, per million tokens."""
    return windows.withColumn("rate", F.when(F.col("tokens") > 0, (F.col("rise") - F.col("known")) / F.col("tokens") * 1e6))


def fold_segments(entries: DataFrame) -> DataFrame:
    """T4: entries folded by who speaks."""
    user, mate, reply = S.fold(F.col("text"), 500, 300, 200), S.fold(F.col("text"), 300, 300, 0), S.fold(F.col("text"), 200, 100, 100)
    return entries.withColumn("text", F.when(F.col("role").isin("User", "System"), user).when(F.col("role") == "Teammate", mate).otherwise(reply))


def ledger_segments(entries: DataFrame) -> DataFrame:
    """Verbatim entries grouped by the run that appended them."""
    return entries.groupBy("sid", "batch").agg(F.array_sort(F.collect_list(F.struct("line", "role", "text"))).alias("entries"))


def abbreviated_dialogue(lines: DataFrame) -> DataFrame:
    """Neighbouring lines of one role are joined and folded; pointers to pointers are reduced to the innermost."""
    order = Window.partitionBy("sid").orderBy("line")
    fresh = F.coalesce(F.col("role") != F.lag("role").over(order), F.lit(True)).cast("int")
    runs = lines.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order))
    joined = runs.groupBy("sid", "run").agg(F.first("role").alias("role"), F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    inner = F.regexp_replace("text", r"L\d+->(?=L\d)", "")
    return joined.withColumn("text", F.when(F.col("role") == "user", S.fold(inner, 500, 300, 200)).otherwise(S.fold(inner, 200, 100, 100)))


def compact_transcripts(lines: DataFrame) -> DataFrame:
    """One row per turn: markers, preview, line range, and previews of the replies with their structure counts."""
    from .turns import group_turns

    cleaned = lines.withColumn("text", S.strip_boilerplate(F.col("text"))).where("text <> ''")
    turns = group_turns(cleaned)

    def preview(r: Column) -> Column:
        n = S.structure_counts(r["text"])
        return F.struct(r["line"].alias("line"), S.truncate_reply(r["text"]).alias("text"), n["code"].alias("code"), n["table"].alias("table"), n["list"].alias("list"))

    shown = turns.withColumn("preview", S.truncate_user(S.abstract_structures(F.col("text")))).withColumn("replies", F.transform("replies", preview)).drop("text")
    return marked_transcripts(shown, lines)
