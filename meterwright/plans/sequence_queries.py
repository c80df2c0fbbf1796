"""Queries of operators that go through rows in order (greedy matches, cuts, budgets), with twins that count or recurse instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limits, restore, sessions, turns
from . import adapter
from .adapter import sql
from .more_queries import QUERIES as MORE
from .record_queries import _cut_twin, _folded
from .report_queries import _near_sides
from .text_queries import SAMPLES, STRIP


def _prioritized(s, d):
    return adapter.turns(s, d).withColumn("priority", F.when(F.col("role") == "user", 0).otherwise(1))


def _recursive(body: str, *more: str) -> str:
    return sql(body, *more).replace("WITH ", "WITH RECURSIVE ", 1)


def _ascii(text: str) -> str:
    return rf"length(regexp_replace({text}, '[^\x00-\x7F]', '', 'g'))"


def _tokens(text: str, ascii_chars: float, other: str) -> str:
    """SQL of a token estimate; the divisors are doubles, as in Spark."""
    return f"ceil({_ascii(text)} / {ascii_chars}::DOUBLE + (length({text}) - {_ascii(text)}) {other})::BIGINT"


def _tail_twin(columns: str, cap: int) -> str:
    """T10 by trying every length of a cut text."""
    tokens = lambda text: _tokens(text, 2.1, "* 1.35::DOUBLE")
    longest = lambda part, room: f"len(list_filter(range(1, chars + 1), lambda k: {tokens(f'{part}(text, k::INT)')} <= {room}))"
    newer = "OVER (PARTITION BY sid ORDER BY line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH c AS (SELECT conv_id AS sid, turn AS line, role, coalesce(text, '') AS text FROM conversations),
    a AS (SELECT *, coalesce(sum((role = 'user')::INT) {newer}, 0) AS asked FROM c),
    n AS (SELECT *, {tokens("text")} AS n, length(text) AS chars FROM a WHERE asked < 2),
    o AS (SELECT *, sum(n) OVER w > {cap} AS over, line = min(line) OVER w AND role = 'user' AS opening FROM n WINDOW w AS (PARTITION BY sid)),
    r AS (SELECT *, coalesce(max(CASE WHEN opening THEN least(n, {cap // 2}) END) OVER (PARTITION BY sid), 0) AS reserve, coalesce(sum(CASE WHEN opening THEN 0 ELSE n END) {newer}, 0) AS newer FROM o),
    k AS (SELECT *, {cap - restore.NOTE_TOKENS} - reserve - newer AS room FROM r),
    cuts AS (SELECT *, CASE WHEN NOT over OR (opening AND n <= reserve) OR (NOT opening AND n <= room) THEN chars WHEN opening THEN {longest("left", "reserve")} ELSE {longest("right", "room")} END AS kept FROM k),
    l AS (SELECT *, (sum((NOT opening AND kept = 0 AND chars > 0)::INT) OVER w)::BIGINT AS omitted_lines, (sum(chars - kept) OVER w)::BIGINT AS omitted_chars FROM cuts WINDOW w AS (PARTITION BY sid)),
    s AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY opening, line) = 1 AS noted FROM l WHERE opening OR kept > 0 OR (chars = 0 AND (NOT over OR newer <= {cap}))),
    t AS (SELECT sid, line, CASE WHEN noted AND omitted_chars > 0 THEN '[…' || omitted_lines || ' lines, ' || omitted_chars || ' characters left out…] ' ELSE '' END || CASE WHEN opening THEN left(text, kept::INT) ELSE right(text, kept::INT) END AS text, kept < chars AS cut, omitted_lines, omitted_chars FROM s)
    SELECT {columns} FROM (SELECT *, (sum({tokens("text")}) OVER (PARTITION BY sid ORDER BY line DESC))::BIGINT AS used FROM t)"""


def _restore_twin(columns: str, budget: int) -> str:
    """T5 by running sums: a line is a block, every block costs something, so what fits is what a sum up to it leaves below the budget."""
    tokens = lambda text: f"({_tokens(text, 4, '/ 1.5::DOUBLE')} + 1)"
    first, second = (tokens(f"'{s.title}'") for s in restore.SECTIONS[:2])
    order = "OVER (PARTITION BY sid ORDER BY line DESC)"
    return f"""WITH c AS (SELECT conv_id AS sid, turn AS line, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS priority, coalesce(text, '') AS text, {STRIP.format("coalesce(text, '')")} AS t FROM conversations),
    f AS (SELECT *, {_folded("t", 200, 100, 100)} AS folded FROM c),
    n AS (SELECT *, {tokens("text")} AS whole, {tokens("folded")} AS short, row_number() OVER (PARTITION BY sid, priority ORDER BY line DESC) = 1 AS newest FROM f),
    a AS (SELECT *, newest AND {first} + whole <= {budget} AS verbatim FROM n WHERE priority = 0),
    au AS (SELECT *, sum(CASE WHEN newest THEN {first} ELSE 0 END + CASE WHEN verbatim THEN whole ELSE short END) {order} AS used FROM a),
    taken AS (SELECT * FROM au WHERE used <= {budget}),
    spent AS (SELECT sid, max(used) AS spent FROM taken GROUP BY sid),
    b AS (SELECT n.*, false AS verbatim, coalesce(spent, 0) + sum(CASE WHEN newest THEN {second} ELSE 0 END + short) {order} AS used FROM n LEFT JOIN spent USING (sid) WHERE priority = 1),
    every AS (SELECT sid, priority, line, text, folded, verbatim, used FROM taken UNION ALL SELECT sid, priority, line, text, folded, verbatim, used FROM b WHERE used <= {budget})
    SELECT {columns} FROM (SELECT sid, priority, line, CASE WHEN verbatim THEN text ELSE folded END AS text, CASE WHEN verbatim THEN 'verbatim' ELSE 'folded' END AS how, used::BIGINT AS used FROM every)"""


#: The runs of W24 as common table expressions: the twin of its query up to the rows with their run.
_RUNS = MORE["w24_burn_runs"][1].split("\nSELECT ")[0].removeprefix("WITH ")


QUERIES = {
    "j10_nearest_once": (
        lambda s, d: turns.merge_nearest_once(*_near_sides(s, d)),
        _recursive(
            "SELECT w.sid, m.line, w.agent FROM walk w JOIN m USING (sid, n) WHERE w.agent IS NOT NULL",
            "m AS (SELECT sid, line, ts_s, row_number() OVER (PARTITION BY sid ORDER BY ts_s, line) AS n FROM settled WHERE parent IS NULL)",
            "a AS (SELECT parent AS sid, ts_s, sid || '-' || line AS agent FROM settled WHERE parent IS NOT NULL)",
            # a step settles the next mark of every session; what is used up goes along as a list
            "free AS (SELECT m.sid, m.n, list({'d': abs(a.ts_s - m.ts_s), 'ts_s': a.ts_s, 'agent': a.agent} ORDER BY abs(a.ts_s - m.ts_s), a.ts_s, a.agent) AS near FROM m JOIN a ON a.sid = m.sid AND abs(a.ts_s - m.ts_s) <= 600 GROUP BY m.sid, m.n)",
            "steps AS (SELECT m.sid, m.n, near FROM m LEFT JOIN free USING (sid, n))",
            "walk AS (SELECT DISTINCT sid, 0::BIGINT AS n, NULL::VARCHAR AS agent, []::VARCHAR[] AS used FROM m UNION ALL "
            "SELECT sid, n, agent, CASE WHEN agent IS NULL THEN used ELSE list_append(used, agent) END FROM (SELECT s.sid, s.n, list_filter(s.near, lambda x: NOT list_contains(w.used, x.agent))[1].agent AS agent, w.used FROM walk w JOIN steps s ON s.sid = w.sid AND s.n = w.n + 1))",
        ),
    ),
    "w25_burn_intervals": (
        lambda s, d: limits.burn_intervals(adapter.limit_samples(s, d), ["lane"]),
        f"WITH RECURSIVE {_RUNS},\n"
        "tops AS (SELECT lane, run, top, min(ts_s) AS since FROM (SELECT *, max(used_percent) OVER (PARTITION BY lane, run ORDER BY ts_s, line) AS top FROM runs) GROUP BY lane, run, top),\n"
        # each cut is the lowest value of the envelope five points or more above the one before
        "cuts AS (SELECT lane, run, min(top) AS top FROM tops GROUP BY lane, run UNION ALL SELECT c.lane, c.run, min(t.top) FROM cuts c JOIN tops t ON t.lane = c.lane AND t.run = c.run AND t.top >= c.top + 5 GROUP BY c.lane, c.run)\n"
        'SELECT lane, run::BIGINT AS run, since AS start, lead(since) OVER w AS "end", lead(top) OVER w - top AS rise FROM cuts JOIN tops USING (lane, run, top) WINDOW w AS (PARTITION BY lane, run ORDER BY top) QUALIFY "end" IS NOT NULL',
    ),
    "t1_compact_transcripts": (
        lambda s, d: sessions.compact_transcripts(adapter.turns(s, d)).select("sid", "turn", "from_line", "to_line", "markers", "preview", F.size("replies").alias("replies")),
        rf"""WITH c AS (SELECT conv_id AS sid, turn AS line, role, {STRIP.format("coalesce(text, '')")} AS text FROM conversations),
        k AS (SELECT *, sum((role IN ('user', 'system'))::INT) OVER (PARTITION BY sid ORDER BY line) AS turn FROM c WHERE text <> ''),
        g AS (SELECT sid, turn::BIGINT AS turn, min(line) AS from_line, max(line) AS to_line, arg_min(text, line) AS text, count(*) FILTER (WHERE role NOT IN ('user', 'system'))::INT AS replies FROM k WHERE turn > 0 GROUP BY ALL),
        f AS (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS t, greatest(1, len(string_split(text, chr(10))) - 2) AS lines FROM g),
        p AS (SELECT *, length(t) AS n FROM f),
        u AS (SELECT sid, role, min(line) FILTER (WHERE role = 'user' AND text <> '') OVER (PARTITION BY sid ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opener FROM c),
        m AS (SELECT sid, opener, CASE WHEN bool_or(role = 'system') THEN '+' WHEN opener = min(opener) OVER (PARTITION BY sid) THEN '@' ELSE '' END AS markers FROM u WHERE opener IS NOT NULL GROUP BY sid, opener)
        SELECT p.sid, turn, from_line, to_line, coalesce(markers, '') AS markers, {_cut_twin(500, 300, 200, "' ..[' || lines || 'lines omitted].. '")} AS preview, replies FROM p LEFT JOIN m ON m.sid = p.sid AND m.opener = p.from_line""",
    ),
    "t4_fold_segments": (
        lambda s, d: sessions.fold_segments(adapter.turns(s, d).withColumn("role", F.when(F.col("role") == "user", "User").otherwise("Assistant"))).select("sid", "line", F.char_length("text").cast("long").alias("n")),
        f"SELECT sid, line, length(CASE WHEN role = 'user' THEN {_folded('t', 500, 300, 200)} ELSE {_folded('t', 200, 100, 100)} END) AS n FROM (SELECT conv_id AS sid, turn AS line, role, {STRIP.format('text')} AS t FROM conversations)",
    ),
    "t5_restore_sections": (lambda s, d: restore.restore_sections(_prioritized(s, d), 800).select("sid", "line", "used"), _restore_twin("sid, line, used", 800)),
    "t5_tight_budgets": (lambda s, d: restore.restore_sections(_prioritized(s, d), 120).select("sid", "priority", "line", "text", "how", "used"), _restore_twin("sid, priority, line, text, how, used", 120)),
    "t9_dialogue": (
        lambda s, d: sessions.abbreviated_dialogue(adapter.turns(s, d)).select("sid", "run", "role", "line", "text"),
        "WITH f AS (SELECT conv_id AS sid, turn AS line, role, text, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true) AS fresh FROM conversations), "
        "g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY sid ORDER BY line) AS run FROM f), "
        f"j AS (SELECT sid, run, min(role) AS role, min(line) AS line, {STRIP.format('string_agg(text, chr(10) ORDER BY line)')} AS t FROM g GROUP BY sid, run) "
        f"SELECT sid, run::BIGINT AS run, role, line, CASE WHEN role = 'user' THEN {_folded('t', 500, 300, 200)} ELSE {_folded('t', 200, 100, 100)} END AS text FROM j",
    ),
    "t10_verbatim_tail": (lambda s, d: restore.verbatim_tail(adapter.turns(s, d)).select("sid", "line", "used"), _tail_twin("sid, line, used", 4000)),
    "t10_cut_tails": (lambda s, d: restore.verbatim_tail(adapter.turns(s, d), cap=300).select("sid", "line", "text", "used", "cut", "omitted_lines", "omitted_chars"), _tail_twin("sid, line, text, used, cut, omitted_lines, omitted_chars", 300)),
}
