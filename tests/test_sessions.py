"""Fixture tests of the session, marker and study operators."""

import random

import pytest
from pyspark.sql import functions as F

from meterwright.operators import sessions, turns


def test_markers_stack_on_the_next_turn(spark):
    marks = [(1, "+", False), (2, "++", False), (3, "~", False), (4, None, True), (5, "@", False), (6, None, True), (7, "!", False), (8, "@@", False), (9, None, True), (10, "+", False)]
    df = spark.createDataFrame([("s", n, m, t) for n, m, t in marks], "sid string, line long, marker string, is_turn boolean")
    assert {r.turn: r.markers for r in sessions.stack_markers(df).collect()} == {4: "++~", 6: "@", 9: "@@!"}


def test_restore_sequences(spark):
    rows = [(1, "read", "x"), (2, "restore", None), (3, "read", "a"), (4, "read", "b"), (5, "reply", None), (6, "read", "c"), (7, "restore", None), (8, "reply", None)]
    df = spark.createDataFrame([("s", *r) for r in rows], "sid string, line long, kind string, target string")
    assert {r.restore: r.read for r in sessions.restore_sequences(df).collect()} == {2: ["a", "b"], 7: []}


def test_named_sessions(spark):
    a, b = "0123abcd-0000-0000-0000-000000000000", "99999999-1111-1111-1111-111111111111"
    known = spark.createDataFrame([(a, 0, 10), (b, 0, 500), ("me", 100, 200)], "sid string, first_ts long, last_ts long")
    texts = spark.createDataFrame([("me", f"see 0123abcd and {b} and deadbeef")], "sid string, text string")
    assert [r.named for r in sessions.named_sessions(texts, known).collect()] == [a]


def test_records_by_speaker(spark):
    rows = [("user", False, "hi", False), ("user", False, "x", True), ("user", True, "meta", False), ("user", False, "<teammate-message a>", False), ("assistant", False, " ", False), ("assistant", False, "ok", False), ("system", False, "s", False)]
    df = spark.createDataFrame(rows, "kind string, is_meta boolean, text string, tool boolean")
    got = [r.c for r in df.select(sessions.classify_record(F.col("kind"), F.col("is_meta"), F.col("text"), F.col("tool")).alias("c")).collect()]
    assert got == ["User", None, "Machine", "Teammate", None, "Assistant", "System"]


def test_observed_thresholds(spark):
    rows = [("m", 1, 50, 100, 10), ("m", 2, 60, 100, 10), ("m", 3, 70, 100, 9999), ("n", 1, 50, 100, 10), ("n", 2, 97, 100, 10)]
    df = spark.createDataFrame(rows, "model string, ts_s long, size long, threshold long, quiet_s long")
    assert [tuple(r) for r in sessions.observed_threshold(df).collect()] == [("m", 60)]


def test_context_size(spark):
    rows = [(1, "a", 100, 0), (2, "b", 150, 0), (3, "b", 160, 0), (4, None, None, 7), (5, None, None, 5)]
    df = spark.createDataFrame([("s", *r) for r in rows], "sid string, line long, req string, usage long, estimate long")
    assert sessions.context_size(df).first().context == 172


def test_qualified_windows(spark):
    up = [(n, 10.0 * n, 1.0 * n) for n in range(4)]
    down = [(0, 30.0, 1.0), (1, 20.0, 3.0)]
    df = spark.createDataFrame([(1, "a", t, t, p, q) for t, p, q in up] + [(1, "b", t, t, p, q) for t, p, q in up[:2]] + [(2, "a", t, t, p, q) for t, p, q in down], "win long, sid string, ts_s long, line long, pct_5h double, pct_7d double")
    assert [(r.win, r.sid, r.rise_5h, r.rise_7d) for r in sessions.qualified_windows(df).collect()] == [(1, "a", 30.0, 3.0)]


def test_restored_context_and_savings(spark):
    rows = spark.createDataFrame([("a", 1, 1, 100), ("a", 2, 2, 400), ("b", 1, 1, 50)], "sid string, ts_s long, line long, cr long")
    restores = spark.createDataFrame([("r", ["a", "b", "a", "gone"])], "restore string, read array<string>")
    context = sessions.restored_context(restores, rows)
    assert context.first().context == 450
    rates = spark.createDataFrame([(50, 1000, 2500)], "r_cr long, r_cc1h long, r_out long")
    r = sessions.restore_savings(context, rates).first()
    assert (r.best_e8, r.worst_e8) == (450 * 50 + 45 * 2500, 450 * 1000 + 45 * 2500)


def test_turns_and_restore_view(spark):
    roles = ["assistant", "user", "assistant", "assistant", "assistant", "system", "user"]
    df = spark.createDataFrame([("s", n, r, f"{r} {n} " + "x" * 80) for n, r in enumerate(roles)], "sid string, line long, role string, text string")
    grouped = turns.group_turns(df)
    assert sorted((r.from_line, r.to_line, len(r.replies)) for r in grouped.collect()) == [(1, 4, 3), (5, 5, 0), (6, 6, 0)]
    view = turns.restore_view(grouped, df.where("role = 'system'"), keep=1).collect()
    assert len(view) == 1 and [len(x) for x in view[0].replies] == [92, 50, 92]


def test_budget_takes_a_prefix(spark):
    df = spark.createDataFrame([("s", n, 10) for n in range(10)], "sid string, line long, tokens long")
    assert sorted(r.line for r in turns.budget_select(df, 36, heading=3).collect()) == [7, 8, 9]


@pytest.mark.parametrize("after", [(3, 10), (0, 0), (-4, 2), (180, 1800)])
def test_jumps_against_every_pair(spark, after):
    rng = random.Random(after[1])
    at = lambda: None if rng.random() < 0.03 else rng.choice([rng.randrange(-30, 60), rng.randrange(-3000, 6000), 50_000])
    key = lambda: rng.choice([1, 1, 2, 3, None])
    calls = [(key(), at(), line, rng.choice([None, 10, 10_000, 20_000])) for line in range(300)]
    # the same write twice stays two rows; a key without readings, a reading without a value
    calls += calls[:5] + [(4, 5, 900, 10_000), (4, 8, 901, 0)]
    readings = [(key(), at(), rng.choice([None, 1.0, 5.0, 50.0 + k % 40]), k) for k in range(60)]
    rows = spark.createDataFrame(calls, "grp long, ts_s long, line long, cc long")
    got = sessions.jump_study(rows, spark.createDataFrame(readings, "grp long, ts_s long, used_percent double, line long"), "grp", after=after)
    # no span is read row by row for each write, which grew with the square of a key's rows
    assert f"RangeFrame, {after[0]}, {after[1]}" not in got._jdf.queryExecution().toString()

    def want(g, t, line, cc):
        inside = lambda grp, ts: None not in (g, t, ts) and grp == g and t + after[0] <= ts <= t + after[1]
        most = max((u for grp, ts, u, _ in readings if u is not None and inside(grp, ts)), default=None)
        top = max((u for grp, ts, u, _ in readings if None not in (u, ts, t, g) and grp == g and ts <= t), default=None)
        return g, t, line, cc, None if None in (most, top) else most - top, sum(inside(c[0], c[1]) for c in calls)

    order = lambda found: sorted(found, key=str)
    assert order(tuple(r) for r in got.collect()) == order(want(*c) for c in calls if (c[3] or 0) >= 10_000)
