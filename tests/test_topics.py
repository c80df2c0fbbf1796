"""Topic search, spans, resets, blocks and SQL functions against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterwright.functions import scalars as S
from meterwright.operators import limits, report, sessions, turns, windows


def plain_topics(docs, queries, k):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    tf = {i: Counter(words(t)) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in queries:
        asked = set(words(text))
        scores = [(-round(sum(c[w] * math.log((len(docs) + 1) / (df[w] + 1)) for w in asked if w in c), 6), i) for i, c in tf.items() if asked & set(c)]
        out += [(q, i, pytest.approx(-s, abs=2e-6), n + 1) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("cells", [1, 4_000_000])
def test_topics_against_a_plain_ranking(spark, monkeypatch, cells):
    monkeypatch.setattr(turns, "QUERY_CELLS", cells)
    rng = random.Random(6)
    docs = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 30)))) for k in range(300)] + [(900, None), (901, ""), (902, "only common common"), (903, "Ünï-code w1")]
    queries = [(q, " ".join(f"W{rng.randrange(70)}" for _ in range(5))) for q in range(8)] + [(20, None), (21, "nowhere"), (22, "ünï")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(5)
    got = turns.topic_turns(df, spark.createDataFrame(queries, "query long, text string"), 7).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"], r["score"], r["rank"]) for r in got] == plain_topics(docs, queries, 7)


def test_topics_of_empty_tables(spark):
    docs, queries = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "query long, text string")
    assert turns.topic_turns(docs, queries).count() == 0
    assert turns.topic_turns(docs.limit(0), spark.createDataFrame([(1, "a")], "query long, text string")).count() == 0


def test_blocks_of_a_round_the_clock_account(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for account in ("a", "b", None):
        times = sorted({rng.randrange(0, 40 * 86400, 60) for _ in range(3000)})
        until = None
        for t in times:
            if until is None or t >= until:
                want[account, t] = True
                until = t + windows.FIVE_HOURS
            rows.append((account, t))
    rows += [("a", None), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "account string, ts_s long").repartition(6)
    assert {(r.account, r.start) for r in windows.anchors(df, ["account"]).collect()} == set(want)
    assert windows.anchors(df.limit(0), ["account"]).count() == 0


def test_used_in_spans_against_a_plain_search(spark):
    rng = random.Random(5)
    samples = [(rng.choice("pq"), rng.randrange(2000), n, float(rng.randrange(100))) for n in range(300)]
    spans = [(k, s, s + rng.randrange(1, 400)) for k in "pq" for s in rng.sample(range(2200), 25)]
    got = windows.used_in_span(spark.createDataFrame(samples, "lane string, ts_s long, line long, used_percent double"), spark.createDataFrame(spans, "lane string, span_start long, span_end long"), ["lane"])
    want = []
    for lane, a, b in spans:
        mine = sorted((t, n, u) for k, t, n, u in samples if k == lane)
        before, inside = [u for t, _, u in mine if t < a], [u for t, _, u in mine if a <= t < b]
        if inside:
            want.append((lane, a, b, before[-1] if before else None, inside[0], inside[-1], inside[-1] - (before[-1] if before else inside[0])))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_resets_near_and_far(spark):
    rng = random.Random(7)
    starts, resets = [rng.randrange(10**6) for _ in range(300)], [rng.randrange(10**6) for _ in range(40)]
    got = limits.drop_near_resets(spark.createDataFrame([(s,) for s in starts], "start long"), spark.createDataFrame([(r,) for r in resets], "reset long"), 3600)
    assert sorted(r.start for r in got.collect()) == sorted(s for s in starts if all(abs(s - r) > 3600 for r in resets))
    days = limits.exclude_event_days(spark.createDataFrame([(5,), (86400,), (2 * 86400 - 1,), (2 * 86400,)], "start long"), spark.createDataFrame([(1,), (1,)], "day long"))
    assert sorted(r.start for r in days.collect()) == [5, 2 * 86400]


def test_burn_runs_need_a_confirmed_drop(spark):
    used = [10, 30, 50, 20, 51, 60, 20, 21, 22, 23, 40]
    df = spark.createDataFrame([("x", 100 * n, n, float(u)) for n, u in enumerate(used)] + [("x", 50_000, 99, 41.0)], "lane string, ts_s long, line long, used_percent double")
    got = [(r.run, r.start, r.end, r.readings, r.first, r.top) for r in limits.burn_runs(df, ["lane"]).orderBy("run").collect()]
    assert got == [(1, 0, 500, 6, 10.0, 60.0), (2, 600, 1000, 5, 20.0, 40.0), (3, 50_000, 50_000, 1, 41.0, 41.0)]


def test_sql_functions_agree_with_their_columns(spark):
    S.register(spark)
    df = spark.createDataFrame([(1, " Ab12é ", 200_000, 32_000, 80.0, 1767323045), (2, "x" * 50 + "日本", 1_000_000, 8_000, 0.0, 86_399)], "id long, t string, win long, out long, pct double, ts long")
    pairs = {
        "account_hash(t)": S.account_hash(F.col("t")), "short_hash(t)": S.short_hash(F.col("t")), "redact('sid', t)": S.redact("sid", F.col("t")), "round2(pct / 7)": S.round2(F.col("pct") / 7),
        "mask_digits(t)": S.mask_digits(F.col("t")), "project_key(t)": S.project_key(F.col("t")), "date_label(ts)": S.date_key(F.col("ts")), "time_label(ts)": S.time_label(F.col("ts")),
        "est_tokens_a(t)": S.est_tokens_a(F.col("t")), "est_tokens_b(t)": S.est_tokens_b(F.col("t")), "compact_threshold(win, out, pct)": S.compact_threshold(F.col("win"), F.col("out"), F.col("pct")),
    }
    for text, column in pairs.items():
        for r in df.select(F.expr(text).alias("a"), column.alias("b")).collect():
            assert r.a == r.b, text


def test_burn_intervals_against_a_plain_walk(spark):
    """Within a run the upper envelope is cut each time five points have come together."""
    rng = random.Random(11)
    samples, t = [], 0
    for n in range(400):
        t += rng.choice([60, 300, 900, 8000])
        samples.append(("x", t, n, float(rng.randrange(0, 100)) if n % 40 == 0 else min(100.0, samples[-1][3] + rng.choice([0, 1, 2, -1, 3])) if samples else 0.0))
    want, run, top, last = [], [], None, None
    for k, (_, at, _, used) in enumerate(samples):
        ahead = max(u for *_, u in samples[k : k + 4])
        if last is None or at - last[0] > 7200 or (last[1] - used > 8 and ahead < last[1] - 8):
            run, top = [(used, at)], used
        elif used > top:
            top = used
            if used - run[-1][0] >= 5:
                want.append((run[-1][1], at, used - run[-1][0]))
                run.append((used, at))
        last = (at, used)
    df = spark.createDataFrame(samples, "lane string, ts_s long, line long, used_percent double")
    assert sorted((r.start, r.end, r.rise) for r in limits.burn_intervals(df, ["lane"]).collect()) == sorted(want) and len(want) > 20


LONG = [
    # a list of more lines than a stack has room for, wide and long tables, and their neighbours
    ("- a\n" * 30_000 + "end", "[List]end"),
    ("|a|b|\n|" + "-|" * 20_000 + "\n" + "|1|2|\n" * 30_000 + "end", "[Table]end"),
    ("```\n" + "x\n" * 30_000 + "``` end", "[Code] end"),
    # an open fence is none; three marks end a fence of four
    ("a\n```\n- b", "a\n```\n- b"),
    ("````\n```\n x", "[Code]\n x"),
    ("```\n- a\n- b\n- c\n``` ```x``` ```", "[Code] [Code] ```"),
    # blank lines and up to four blanks belong to a list; two lines are none; a line that is too long is no item
    ("x\n\n- a\n\n- b\n  - c\n1) d\n\ny", "x\n[List]\ny"),
    ("- a\n- b\n", "- a\n- b\n"),
    ("- a\n- b\n- " + "c" * 501 + "\n- d", "- a\n- b\n- " + "c" * 501 + "\n- d"),
    # a table needs its rule on the second line, with a line end; what follows a row on its line stays
    ("|a|b|\n|---|---|", "|a|b|\n|---|---|"),
    ("|a|b|\n|---|---|\n|1|2| rest\n", "[Table] rest\n"),
    ("|a|\n|---|\n", "|a|\n|---|\n"),
    # the line after a table is on the placeholder's line
    ("|a|b|\n|---|---|\n- v\n- x\n- y\n- z\n", "[Table]- v\n[List]"),
    ("", ""),
]


def test_structures_of_any_length(spark):
    got = spark.createDataFrame(list(enumerate(t for t, _ in LONG)), "n long, t string").select("n", S.abstract_structures(F.col("t")).alias("a"))
    assert [r.a for r in got.orderBy("n").collect()] == [a for _, a in LONG]


def _plain_cut(text, head, tail, over, note):
    """The rule of the cut, character by character."""
    t = " ".join(text.split())
    if len(t) <= over:
        return t

    def snap(at, order):
        return next((p for p in order if 0 <= p < len(t) and t[p].isspace()), at)

    k, b = head, len(t) - tail
    a = snap(k, [k - i for i in range(6)] + [k + i for i in range(1, 6)])
    b = snap(b, [b + i for i in range(6)] + [b - i for i in range(1, 6)])
    return t[:a].strip() + note + t[b:].strip()


def test_cuts_against_a_plain_rule(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab 漢\n") for _ in range(rnd.choice([0, 1, 199, 200, 201, 206, 499, 500, 501, 520, 4000]))) for _ in range(80)]
    texts += ["x" * 201, "x" * 501, "y" * 100 + " " + "x" * 300, "word " * 1_000_000]
    got = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", S.truncate_user(F.col("t")).alias("u"), S.truncate_reply(F.col("t")).alias("r"))
    for row, text in zip(got.orderBy("n").collect(), texts, strict=True):
        lines = max(1, text.count("\n") - 1)
        assert row.u == _plain_cut(text, 300, 200, 500, f" ..[{lines}lines omitted].. ")
        assert row.r == _plain_cut(text, 100, 100, 200, " [...truncated...] ")
    none = spark.createDataFrame([(None,)], "t string").select(S.truncate_user(F.col("t")), S.truncate_reply(F.col("t")), S.abstract_structures(F.col("t"))).first()
    assert tuple(none) == (None, None, None)


def test_chains_of_pointers(spark):
    lines = spark.createDataFrame([(1, 1, "user", "L1->" * 20_000 + "L7 a"), (1, 2, "assistant", "L1->L2->x"), (1, 3, "user", "L1-> L2")], "sid long, line long, role string, text string")
    got = sessions.abbreviated_dialogue(lines).orderBy("line").collect()
    assert [r.text for r in got] == ["L7 a", "L2->x", "L1-> L2"]


def test_usage_of_overlapping_windows_against_a_plain_sum(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcd"), rng.choice((rng.randrange(4000), rng.randrange(900, 1200), 900)), rng.randrange(100), *(rng.randrange(9) for _ in range(4))) for _ in range(600)]
    rows += [("a", None, 5, 1, 1, 1, 1), (None, 950, 7, 1, 1, 1, 1)]
    spans = [("x", 0, 900), ("x", 300, 1200), ("y", 899, 901), ("y", 901, 3700), ("y", 950, 950), ("z", 5000, 6000), ("z", 1, 599), (None, 600, 900)]
    df = spark.createDataFrame(rows, "sid string, ts_s long, cost_e8 long, input long, cc long, cr long, out long")
    windows = spark.createDataFrame(spans, "lane string, start long, active_end long")
    want = []
    for lane, start, end in spans:
        held = [r for r in rows if r[1] is not None and start <= r[1] < end]
        if held:
            want.append((lane, start, sum(r[2] for r in held), sum(sum(r[3:]) for r in held), len(held), len({r[0] for r in held} - {None})))
    for bucket in (1, 7, 300, 18_000):
        got = report.window_usage(df, windows, bucket).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)), bucket
    assert report.window_usage(df.limit(0), windows).count() == 0 and report.window_usage(df, windows.limit(0)).count() == 0
