"""Restores under one token budget, the verbatim tail of a session, and the markers of compact transcripts."""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


class Section(NamedTuple):
    """Heading of a section, and how its blocks may stand in it: ``newest`` (its first block verbatim, else folded, else
    its last entries; the others folded), ``folded`` or ``verbatim``."""

    title: str
    mode: str


#: Headings of a restore, in order of priority.
SECTIONS = (
    Section("## 1. This session: newest segment", "newest"),
    Section("## 2. This session: earlier segments (folded)", "folded"),
    Section("## 3. Handoff written by /s-compact", "verbatim"),
    Section("## 4. Earlier sessions this session names (folded)", "folded"),
)


#: What is known of a block's size.
SIZES = ("from_line", "whole_ascii", "whole_other", "fold_ascii", "fold_other", "tail_line", "tail_cost")


def _tokens(ascii_chars: float, other: float) -> int:
    return math.ceil(ascii_chars / 4 + other / 1.5) + 1


def _text_tokens(text: str) -> int:
    n = sum(c.isascii() for c in text)
    return _tokens(n, len(text) - n)


def _chooser(budget: int, sections: tuple[Section, ...]):
    """Blocks in order (session, section, groups newest first, their blocks newest first), numbers only -> those that are taken."""

    def choose(batches):
        session = section = group = spent = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sid", "priority", "grp", *SIZES)), strict=True)
            taken = []
            for k, (sid, priority, grp, from_line, whole_ascii, whole_other, fold_ascii, fold_other, tail_line, tail_cost) in enumerate(rows):
                if spent is None or sid != session:
                    session, section, spent = sid, None, 0
                if priority != section:
                    section, group, number, closed = priority, None, -1, False
                    title, mode = sections[min(priority, len(sections) - 1)]
                    head = _text_tokens(title) if title else 0
                if grp != group:
                    group, first, full = grp, True, False
                    number += 1
                else:
                    first = False
                if closed or full:
                    continue
                heads = head + (_text_tokens(f"### earlier session {grp}") if grp and first else 0)
                newest = mode == "newest" and number == 0 and first
                ways = []
                if mode == "verbatim" or newest:
                    ways.append(("verbatim", from_line, _tokens(whole_ascii, whole_other)))
                if mode != "verbatim":
                    ways.append(("folded", from_line, _tokens(fold_ascii, fold_other)))
                if newest and tail_line is not None:
                    ways.append(("tail", tail_line, tail_cost))
                way = next((w for w in ways if spent + heads + w[2] <= budget), None)
                if way is None:
                    # a group without a block ends its section
                    full, closed = True, first
                    continue
                spent += heads + way[2]
                head = 0
                taken.append((k, way[0], way[1], spent))
            if taken:
                which, how, line, used = (list(c) for c in zip(*taken, strict=True))
                same = batch.select(["sid", "priority", "grp", "segment"]).take(pa.array(which))
                more = [pa.array(how, pa.string()), pa.array(line, pa.int64()), pa.array(used, pa.int64())]
                yield pa.RecordBatch.from_arrays([*same.columns, *more], names=[*same.schema.names, "how", "from_line", "used"])

    return choose


def restore_sections(entries: DataFrame, budget: int, sections: tuple[Section, ...] = SECTIONS) -> DataFrame:
    """T5: sections in order of priority under one budget.

    ``entries``: sid, priority (number of the section from 0), line, text; ``segment`` (the block an entry belongs to, a
    number that grows with time; without it each line is a block), ``grp`` and ``grp_at`` (an earlier session and its time). A
    section takes its blocks newest first until one does not fit, and the next section is tried all the same; a heading
    counts with the first block under it only. The newest block is never lost for its size alone: verbatim, else folded,
    else as many of its last entries, folded, as fit. Gives sid, priority, segment, line, text as it is restored, how, used (tokens up to and with
    its block). Blocks are walked in order, one row each, numbers only, with a few
    of them in memory; texts are joined to what was taken.
    """
    folded = S.fold(F.col("text"), 200, 100, 100)
    has = lambda name, other: F.col(name) if name in entries.columns else other
    rows = entries.select(
        "sid", F.col("priority").cast("int").alias("priority"), "line", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(has("segment", F.col("line")), F.lit(0)).cast("long").alias("segment"),
        F.coalesce(has("grp", F.lit("")).cast("string"), F.lit("")).alias("grp"), F.coalesce(has("grp_at", F.lit(0)).cast("long"), F.lit(0)).alias("grp_at"),
    ).withColumn("folded", folded)
    ascii_of = {name: S.ascii_chars(F.col(name)) for name in ("text", "folded")}
    rows = rows.withColumns({"wa": ascii_of["text"], "wo": F.char_length("text") - ascii_of["text"], "fa": ascii_of["folded"], "fo": F.char_length("folded") - ascii_of["folded"]})
    block = ["sid", "priority", "grp", "segment"]
    # entries of a block are joined by a line end each; of its last ones the note tells how many are left out
    back = Window.partitionBy(*block).orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumns({"_a": F.sum(F.col("fa") + 1).over(back) - 1, "_o": F.sum("fo").over(back)})
    tail = F.ceil((F.col("_a") + 64) / 4 + F.col("_o") / 1.5) + 1
    head = F.lit(_text_tokens(sections[0].title) if sections[0].title else 0)
    fits = F.when((F.col("priority") == 0) & (head + tail <= budget), F.struct("line", tail.alias("cost")))
    between = F.count(F.lit(1)) - 1
    blocks = sized.groupBy(*block).agg(
        F.max("grp_at").alias("grp_at"), F.min("line").alias("from_line"), (F.sum("wa") + between).alias("whole_ascii"), F.sum("wo").alias("whole_other"),
        (F.sum("fa") + between).alias("fold_ascii"), F.sum("fo").alias("fold_other"), F.min(fits).alias("t"),
    )
    blocks = blocks.select("*", F.col("t.line").alias("tail_line"), F.col("t.cost").alias("tail_cost")).drop("t")
    kind = f"sid {entries.schema['sid'].dataType.simpleString()}, priority int, grp string, segment long, how string, from_line long, used long"
    # a session's sorted blocks are one stretch of one task
    dealt = blocks.where("priority is not null").repartition("sid").withColumn("_at", F.max("grp_at").over(Window.partitionBy("sid", "priority", "grp")))
    order = dealt.sortWithinPartitions("sid", "priority", F.desc("_at"), "grp", F.desc("grp_at"), F.desc("segment"))
    taken = order.select(*block, *[F.col(c).cast("long").alias(c) for c in SIZES]).mapInArrow(_chooser(budget, sections), kind)
    same = [rows[c].eqNullSafe(taken[c]) for c in block]
    out = rows.join(taken, same[0] & same[1] & same[2] & same[3] & (rows["line"] >= taken["from_line"]))
    text = F.when(F.col("how") == "verbatim", rows["text"]).otherwise(rows["folded"])
    return out.select(rows["sid"], rows["priority"], rows["grp"], rows["segment"], rows["line"], text.alias("text"), "how", "used")


#: Tokens that are kept for the note about what is left out.
NOTE_TOKENS = 40


def _longest_end(text: Column, room: Column) -> Column:
    """How many of a text's last characters are at most ``room`` tokens: the estimate over ends grows with them, so it is halved in."""
    n = F.char_length(text)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(F.lit(0).alias("low"), (n + 1).alias("high")),
        lambda acc, _: F.when(
            acc["high"] - acc["low"] <= 1, acc
        ).otherwise(
            F.when(
                S.est_tokens_b(F.substring(text, n - F.floor((acc["low"] + acc["high"]) / 2).cast("int") + 1, n)) <= room,
                F.struct(F.floor((acc["low"] + acc["high"]) / 2).cast("int").alias("low"), acc["high"].alias("high")),
            ).otherwise(F.struct(acc["low"].alias("low"), F.floor((acc["low"] + acc["high"]) / 2).cast("int").alias("high")))
        ),
    )
    return F.when(F.coalesce(room, F.lit(0)) > 0, step["low"]).otherwise(0)


def verbatim_tail(lines: DataFrame, exchanges: int = 2, cap: int = 4000) -> DataFrame:
    """The last ``exchanges`` of a session under a hard cap of tokens: sid, line, role, text, used, cut, omitted_lines, omitted_chars.

    Up to the cap everything stays. Beyond it the opening user line stays (at most half of the cap: its beginning), then
    the newest lines as long as they fit, and the line in which the room ends keeps its end. In front of that stands a note of what is
    left out between the two, told in ``omitted_lines`` and ``omitted_chars`` too. A session without a user line has no opening.
    """
    back = Window.partitionBy("sid").orderBy(F.desc("line"))
    asked = F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = lines.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_asked", asked).where(F.col("_asked") < exchanges)
    whole = Window.partitionBy("sid")
    tail = tail.withColumn("_n", S.est_tokens_b(F.col("text")).cast("long"))
    tail = tail.withColumns({"_all": F.sum("_n").over(whole), "_first": F.min("line").over(whole)})
    opening = (F.col("line") == F.col("_first")) & (F.col("role") == "user")
    tail = tail.withColumn("_opening", opening)
    reserve = F.max(F.when(F.col("_opening"), F.least(F.col("_n"), F.lit(cap // 2)))).over(whole)
    newer = F.sum(F.when(F.col("_opening"), 0).otherwise(F.col("_n"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    tail = tail.withColumns({"_reserve": F.coalesce(reserve, F.lit(0)), "_newer": F.coalesce(newer, F.lit(0))})
    over = F.col("_all") > cap
    # the note's tokens are set aside as soon as something is left out
    room = F.lit(cap - NOTE_TOKENS) - F.col("_reserve") - F.col("_newer")
    end = _longest_end(F.col("text"), room)
    start = F.when(F.col("_n") <= F.col("_reserve"), F.char_length("text")).otherwise(_longest_start(F.col("text"), F.col("_reserve")))
    kept = F.when(~over, F.char_length("text")).when(F.col("_opening"), start).when(F.col("_n") <= room, F.char_length("text")).otherwise(end)
    tail = tail.withColumn("_kept", kept).withColumn("_left", F.char_length("text") - F.col("_kept"))
    lost = F.when(~F.col("_opening") & (F.col("_kept") == 0) & (F.char_length("text") > 0), 1).otherwise(0)
    tail = tail.withColumns({"omitted_lines": F.sum(lost).over(whole), "omitted_chars": F.sum("_left").over(whole)})
    stays = F.col("_opening") | (F.col("_kept") > 0) | ((F.char_length("text") == 0) & (~over | (F.col("_newer") <= cap)))
    tail = tail.where(stays).withColumn("cut", F.col("_left") > 0)
    note = F.concat(F.lit("[…"), F.col("omitted_lines"), F.lit(" lines, "), F.col("omitted_chars"), F.lit(" characters left out…] "))
    part = F.when(F.col("_opening"), F.substring("text", F.lit(1), F.col("_kept"))).otherwise(F.substring("text", F.char_length("text") - F.col("_kept") + 1, F.col("_kept")))
    # the note stands on the oldest line after the opening
    oldest = F.min(F.when(~F.col("_opening"), F.col("line"))).over(whole)
    tail = tail.withColumn("_note", F.when((F.col("omitted_chars") > 0) & (F.col("line") == F.coalesce(oldest, F.col("_first"))), note).otherwise(""))
    tail = tail.withColumn("text", F.concat("_note", part))
    used = F.sum(S.est_tokens_b(F.col("text"))).over(back)
    return tail.withColumn("used", used).select("sid", "line", "role", "text", "used", "cut", "omitted_lines", "omitted_chars")


def _longest_start(text: Column, room: Column) -> Column:
    """How many of a text's first characters are at most ``room`` tokens."""
    return _longest_end(F.reverse(text), room)


# --- markers


def session_marks(lines: DataFrame) -> DataFrame:
    """Adds ``marker`` and ``is_turn`` to lines (sid, line, role, text): what a line leaves for the next genuine user turn.

    A compaction's boundary (role system) gives ``++`` if its ``trigger`` is auto, else ``+``; of the slash commands clear
    gives ``@@``, compact ``+``, reload ``~`` and model ``!``. A genuine user line that is no command is a turn.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.regexp_replace(text, r"(?s)<task-notification>.*?</task-notification>", "")
    command = F.when(F.col("role") == "user", P.slash_command(said))
    trigger = F.col("trigger") if "trigger" in lines.columns else F.lit(None).cast("string")
    marker = (
        F.when(F.col("role") == "system", F.when(trigger == "auto", "++").otherwise("+"))
        .when(command == "clear", "@@").when(command == "compact", "+").when(command == "reload", "~").when(command == "model", "!")
    )
    turn = (F.col("role") == "user") & command.isNull() & P.is_genuine_user(text)
    return lines.withColumns({"marker": marker, "is_turn": F.coalesce(turn, F.lit(False))})


def turn_markers(lines: DataFrame) -> DataFrame:
    """W31 on lines as they are: sid, turn (the line of a genuine user turn), markers. A session's first turn has ``@`` unless something else stands there."""
    from .sessions import stack_markers

    marked = session_marks(lines)
    turns = marked.where("is_turn").select("sid", F.col("line").alias("turn"))
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("sid"))
    stacked = turns.join(stack_markers(marked.select("sid", "line", "marker", "is_turn")), ["sid", "turn"], "left")
    return stacked.withColumn("markers", F.coalesce("markers", F.when(first, "@").otherwise("")))


def marked_transcripts(compact: DataFrame, lines: DataFrame) -> DataFrame:
    """T1 with markers: compact turns (sid, from_line, ...) get the markers of the user line they open with; system turns have none."""
    marks = turn_markers(lines).withColumnRenamed("turn", "from_line")
    return compact.join(marks, ["sid", "from_line"], "left").withColumn("markers", F.coalesce("markers", F.lit("")))


def alert_types(turns: DataFrame) -> DataFrame:
    """T12 from T1's own markers: user turns with alert_type, ``info`` where nothing is marked."""
    m = F.col("markers")
    named = F.array_compact(
        F.array(
            F.when(m.contains("++"), "compact-auto").when(m.contains("+"), "compact-manual"),
            F.when(m.contains("~"), "reload-plugins"),
            F.when(m.contains("!"), "model-change"),
            F.when(m.contains("^^"), "continue-n").when(m.contains("^"), "continue-1"),
            F.when(m.contains("@@"), "clear").when(m.contains("@"), "startup"),
        )
    )
    return turns.where("role = 'user'").withColumn("alert_type", F.when(F.size(named) == 0, "info").otherwise(F.array_join(named, "+")))
