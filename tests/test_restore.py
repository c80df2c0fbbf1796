"""Restores, tails and markers on fixtures and against plain versions."""

import math
import random

import pytest

from meterwright.operators import restore, sessions, turns

ENTRY = "sid string, priority int, line long, text string, segment long, grp string, grp_at long"


def cost(text):
    n = sum(c.isascii() for c in text)
    return math.ceil(n / 4 + (len(text) - n) / 1.5) + 1


def est_b(text):
    n = sum(c.isascii() for c in text)
    return math.ceil(n / 2.1 + (len(text) - n) * 1.35)


def folded(text):
    t = text.strip()
    return t if len(t) <= 200 else f"{t[:100].rstrip()} …[+{len(t) - 200} chars, read L{{n}} for the rest] {t[-100:].lstrip()}"


def plain(entries, budget):
    """One session, entries (priority, line, text, segment, grp, grp_at): {(priority, segment, line): (how, used)}."""
    out, spent = {}, 0
    for priority in sorted({e[0] for e in entries}):
        title, mode = restore.SECTIONS[priority]
        head, stop = cost(title), False
        groups = sorted({(e[4], e[5]) for e in entries if e[0] == priority}, key=lambda g: (-g[1], g[0]))
        for g, (grp, _) in enumerate(groups):
            mine = [e for e in entries if e[0] == priority and e[4] == grp]
            label = cost(f"### earlier session {grp}") if grp else 0
            for k, segment in enumerate(sorted({e[3] for e in mine}, reverse=True)):
                block = sorted((e for e in mine if e[3] == segment), key=lambda e: e[1])
                heads = head + (label if k == 0 else 0)
                whole, short = cost("\n".join(e[2] for e in block)), cost("\n".join(folded(e[2]) for e in block))
                newest = mode == "newest" and g == k == 0
                ways = [("verbatim", block, whole)] if mode == "verbatim" or newest else []
                ways += [("folded", block, short)] if mode != "verbatim" else []
                if newest:
                    ways += [("tail", block[j:], cost("x" * 64 + "\n".join(folded(e[2]) for e in block[j:]))) for j in range(len(block))]
                way = next((w for w in ways if spent + heads + w[2] <= budget), None)
                if way is None:
                    stop = k == 0
                    break
                spent += heads + way[2]
                head = 0
                for e in way[1]:
                    out[priority, segment, e[1]] = (way[0], spent)
            if stop:
                break
    return out


def restored(spark, entries, budget):
    df = spark.createDataFrame([("s", p, line, t, seg, g, at) for p, line, t, seg, g, at in entries], ENTRY)
    return {(r.priority, r.segment, r.line): (r.how, r.used) for r in restore.restore_sections(df, budget).collect()}


def test_a_section_after_one_that_is_full_is_still_tried(spark):
    rows = [("s", 0, 3, "a" * 40), ("s", 0, 2, "b" * 4000), ("s", 1, 1, "c" * 40)]
    df = spark.createDataFrame(rows, "sid string, priority int, line long, text string")
    got = restore.restore_sections(df, 60).collect()
    assert sorted((r.priority, r.line, r.text) for r in got) == [(0, 3, "a" * 40), (1, 1, "c" * 40)]
    assert sorted((r.priority, r.line) for r in sessions.restore_sections(df, 60).collect()) == [(0, 3), (1, 1)]
    assert restore.restore_sections(df, 5).count() == 0 and restore.restore_sections(df.limit(0), 60).count() == 0


@pytest.mark.parametrize("budget", [10, 40, 90, 150, 250, 400, 700, 1500, 4000])
def test_restore_against_a_plain_fold(spark, budget):
    rng, entries, line = random.Random(9), [], 0
    for priority, groups in ((0, [("", 0)]), (1, [("", 0)]), (2, [("", 0)]), (3, [("old", 5), ("older", 3), ("also older", 3)])):
        for grp, at in groups:
            for segment in range(1 if priority in (0, 2) else 5):
                for _ in range(rng.randrange(1, 6)):
                    line += 1
                    entries.append((priority, line, rng.choice("aé") * rng.randrange(1, 400) + ".", segment, grp, at))
    assert restored(spark, entries, budget) == plain(entries, budget)


def test_the_newest_segment_keeps_its_last_entries(spark):
    entries = [(0, k, f"{k} " + "w" * 180, 1, "", 0) for k in range(20)]
    got = restored(spark, entries, 200)
    assert {how for how, _ in got.values()} == {"tail"} and sorted(line for *_, line in got) == list(range(20 - len(got), 20)) and len(got) >= 2


@pytest.mark.parametrize("budget", [40, 150, 700])
def test_many_sessions_are_walked_in_batches_that_cut_them(spark, budget):
    rng, rows, line = random.Random(5), {}, 0
    for sid in ("a", "b", None, "c", "d"):
        for priority, groups in ((0, [("", 0)]), (1, [("", 0)]), (2, [("", 0)]), (3, [("old", 5), ("older", 3)])):
            for grp, at in groups:
                for segment in range(1 if priority == 2 else 4):
                    line += 1
                    rows.setdefault(sid, []).append((priority, line, rng.choice("aé") * rng.randrange(1, 300), segment, grp, at))
    df = spark.createDataFrame([(sid, *e) for sid, es in rows.items() for e in es] + [("a", None, 0, "of no section", 0, "", 0)], ENTRY)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = restore.restore_sections(df, budget)
        # one Python call a session cost more than all else
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        found = {}
        for r in got.collect():
            found.setdefault(r.sid, {})[r.priority, r.segment, r.line] = (r.how, r.used)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {sid: want for sid, es in rows.items() if (want := plain(es, budget))}


# --- tail


def tail(spark, rows, **more):
    df = spark.createDataFrame([("s", *r) for r in rows], "sid string, line long, role string, text string")
    return restore.verbatim_tail(df, **more).orderBy("line").collect()


def test_a_long_reply_is_cut_not_lost(spark):
    text = "".join(chr(97 + k % 26) for k in range(40_000))
    got = tail(spark, [(1, "user", "question"), (2, "assistant", text)])
    assert [(r.line, r.cut) for r in got] == [(1, False), (2, True)] and got[0].text == "question"
    kept = got[1].text.split("] ", 1)[1]
    assert text.endswith(kept) and len(kept) > 8000 and got[0].used <= 4000
    assert got[1].omitted_lines == 0 and got[1].omitted_chars == 40_000 - len(kept)
    # no longer end would fit
    assert est_b(kept) <= 4000 - restore.NOTE_TOKENS - est_b("question") < est_b(text[-len(kept) - 1 :])


def test_tail_under_the_cap_is_whole(spark):
    rows = [(1, "user", "old"), (2, "assistant", "gone"), (3, "user", "a"), (4, "assistant", None), (5, "user", "b"), (6, "assistant", "c"), (7, "assistant", "d")]
    got = tail(spark, rows)
    assert [(r.line, r.text, r.cut, r.omitted_chars) for r in got] == [(n, t or "", False, 0) for n, _, t in rows[2:]]
    assert [r.used for r in got] == [sum(est_b(t or "") for _, _, t in rows[k:]) for k in range(2, 7)]


@pytest.mark.parametrize("cap", [100, 300, 1000])
def test_tail_never_passes_the_cap(spark, cap):
    rng = random.Random(cap)
    rows = [(k, "user" if k in (3, 8) else "assistant", rng.choice("xé") * rng.choice([5, 60, 900])) for k in range(14)]
    got = tail(spark, rows, cap=cap)
    assert got and got[0].used <= cap and got[0].line == 3
    inner = [r.line for r in got if r.line != 3]
    assert inner == list(range(14 - len(inner), 14)) and sum(r.cut for r in got if r.line != 3) <= 1
    whole = {n: t for n, _, t in rows}
    lost = sum(len(whole[n]) for n in range(3, 14)) - sum(len(r.text.split("] ", 1)[-1]) for r in got)
    assert got[0].omitted_chars == lost and got[0].omitted_lines == 14 - 4 - len(inner)


def test_tail_of_odd_sessions(spark):
    opening = "é" * 3000
    got = tail(spark, [(1, "user", opening), (2, "assistant", "ok")], cap=200)
    assert [r.line for r in got] == [1, 2] and got[0].cut and opening.startswith(got[0].text) and got[1].text.endswith("ok")
    assert [r.line for r in tail(spark, [(1, "assistant", "a"), (2, "assistant", "b")])] == [1, 2]
    alone = tail(spark, [(1, "assistant", "y" * 9000)], cap=100)
    assert len(alone) == 1 and alone[0].cut and alone[0].used <= 100
    assert tail(spark, []) == []


# --- markers


def command(name):
    return f"<command-name>/{name}</command-name>"


def test_markers_of_compact_transcripts(spark):
    rows = [
        (1, "user", "first", None), (2, "assistant", "reply", None), (3, "user", command("model"), None), (4, "user", command("compact"), None),
        (5, "system", "boundary", "auto"), (6, "user", "after a compaction", None), (7, "assistant", "x", None), (8, "user", command("plugin:clear"), None),
        (9, "user", command("reload-plugins"), None), (10, "user", "after a clear", None), (11, "user", "plain", None), (12, "system", "boundary", "manual"), (13, "user", "last", None),
        (14, "user", "<task-notification>" + command("clear") + "</task-notification> about it", None), (15, "system", "waits for ever", "auto"),
    ]
    df = spark.createDataFrame([("s", *r) for r in rows] + [("t", 1, "system", "b", "auto"), ("t", 2, "user", "starts after a boundary", None)], "sid string, line long, role string, text string, trigger string")
    got = {(r.sid, r.turn): r.markers for r in restore.turn_markers(df).collect()}
    assert got[("s", 1)] == "@" and got[("s", 6)] == "!++" and got[("s", 10)] == "@@~" and got[("s", 11)] == "" and got[("s", 13)] == "+" and got[("t", 2)] == "++"
    marked = sessions.compact_transcripts(df)
    assert marked.count() == marked.select("sid", "from_line").distinct().count()
    by_line = {(r.sid, r.from_line): (r.role, r.markers) for r in marked.collect()}
    assert by_line[("s", 6)] == ("user", "!++") and by_line[("s", 5)] == ("system", "")
    kinds = {(r.sid, r.from_line): r.alert_type for r in restore.alert_types(marked).collect()}
    assert kinds[("s", 1)] == "startup" and kinds[("s", 6)] == "compact-auto+model-change" and kinds[("s", 10)] == "reload-plugins+clear" and kinds[("s", 11)] == "info"


def test_compact_transcripts_have_their_markers(spark):
    df = spark.createDataFrame([("s", 1, "user", "hello"), ("s", 2, "assistant", "x"), ("s", 3, "system", "b"), ("s", 4, "user", "again")], "sid string, line long, role string, text string")
    got = {r.from_line: r.markers for r in sessions.compact_transcripts(df).collect()}
    assert got == {1: "@", 3: "", 4: "+"}
    assert turns.group_turns(df).count() == 3


def test_tail_without_an_opening_has_the_whole_cap(spark):
    lines = spark.createDataFrame([("s", 0, "system", "x" * 400), ("s", 1, "assistant", "y" * 2000)], "sid string, line long, role string, text string")
    got = restore.verbatim_tail(lines, cap=300).collect()
    # no user line is kept, so nothing is set aside for one: 260 tokens of the reply, which are 546 characters, behind the note
    assert [(r.line, r.cut, r.omitted_lines, r.omitted_chars) for r in got] == [(1, True, 1, 400 + 2000 - 546)]
    assert got[0].text.endswith("] " + "y" * 546) and got[0].used <= 300
