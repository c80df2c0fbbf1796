"""Predicates and small parsers on texts and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of texts that no user typed.
SUBTASK_PREFIXES = (
    "Read the preprocessed transcript",
    "Read the file /tmp/preprocessed",
    "Read the file /tmp/continue-",
    "CRITICAL: Respond with TEXT ONLY",
    "Write the word",
    "Review this change for security vulnerabilities",
    "Review the following code changes",
    "You are reviewing a pull request",
    "[User ",
    "[Request interrupted by user",
)
#: First messages of sessions that a program started.
PROGRAM_PREFIXES = ("You are generating", "Read the ", "Run the ", "CRITICAL:", "Write the word", "Compare the ", "This session is being continued")
#: Beginnings of limit messages.
LIMIT_PREFIXES = ("You've hit your", "You've used", "You're now using extra usage", "You're close to your extra usage", "You're out of extra usage")
INJECTED_PREFIXES = ("<user_instructions>", "<environment_context>", "<permissions", "<collaboration_mode", "# AGENTS.md")


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(lambda x, p: x | text.startswith(p), prefixes, F.lit(False))


def is_genuine_user(text: Column) -> Column:
    """P7."""
    return (F.char_length(text) > 0) & ~starts_with_any(text, SUBTASK_PREFIXES)


def is_programmatic(is_agent: Column, user_records: Column, first_text: Column) -> Column:
    """A main session with one user record that has a program's prefix, or no genuine text."""
    return ~is_agent & (user_records == 1) & (first_text.isNull() | (first_text == "") | starts_with_any(first_text, PROGRAM_PREFIXES))


def is_compact_agent(sid: Column) -> Column:
    """P15."""
    return F.coalesce(sid.startswith("agent-acompact-") | sid.startswith("acompact-"), F.lit(False))


def limit_type(message: Column) -> Column:
    """P16."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.contains("session limit"), "limit_hit_5h")
        .when(low.contains("weekly limit"), "limit_hit_weekly")
        .when(low.contains("opus limit"), "limit_hit_opus")
        .when(low.contains("sonnet limit"), "limit_hit_sonnet")
        .when(low.contains("extra usage"), "limit_hit_extra")
        .otherwise("limit_hit_unknown")
    )


#: Fixed value: how a limit message tells its reset, a format.
RESET_FORMAT = r"(?i)·\s*resets\s+(\S+?)(?:\s+\(([^)]+)\))?(?:\s|$)"


def parse_reset(message: Column) -> Column:
    """``{time@zone}``, ``{time}`` or null."""
    time, zone = F.regexp_extract(message, RESET_FORMAT, 1), F.regexp_extract(message, RESET_FORMAT, 2)
    return F.when(time != "", F.when(zone != "", F.concat(F.lit("{"), time, F.lit("@"), zone, F.lit("}"))).otherwise(F.concat(F.lit("{"), time, F.lit("}"))))


def is_limit_message(error: Column, text: Column) -> Column:
    """An error flag or a known beginning; one row is one event even if both hold."""
    return F.coalesce(error, F.lit(False)) | starts_with_any(F.coalesce(text, F.lit("")), LIMIT_PREFIXES)


def slash_command(text: Column) -> Column:
    """P20: clear, compact, reload, model, other, or null."""
    name = F.element_at(F.split(F.regexp_extract(text, r"<command-name>/?([\w:-]+)</command-name>", 1), ":"), -1)
    return F.when(name == "", None).otherwise(F.when(name.isin("clear", "compact", "model"), name).when(name == "reload-plugins", "reload").otherwise("other"))


def is_machine_prompt(text: Column) -> Column:
    """P21."""
    return text.rlike(r"^\s*<[A-Za-z]")


def is_injected_context(text: Column) -> Column:
    """P22."""
    return starts_with_any(F.ltrim(text), INJECTED_PREFIXES)


def visible(host: Column, cost: Column, tokens: Column) -> Column:
    """Cost counts on one host, tokens on the other."""
    return F.when(host == "codex", tokens > 0).otherwise(cost > 0)


def period_cutoff(today: Column, days: int | None = None, months: int | None = None) -> Column:
    """A start date; months clamp to the month's end. Null: no cutoff."""
    if months is not None:
        return F.add_months(today, -months)
    return F.date_sub(today, days) if days is not None else F.lit(None).cast("date")
