"""Queries of operators on records of transcripts: the test tables are written as JSON records, parsed and read back, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import exports, restore, sessions, turns
from ..sources import transcripts
from . import adapter
from .adapter import settled, sql
from .more_queries import COMMANDS, _commands
from .text_queries import STRIP


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def _parsed(rows, record, *keep):
    """Rows as the transcripts' readers give them: v is the parsed record."""
    return rows.select(*keep, F.try_parse_json(F.to_json(record)).alias("v"))


def _block(kind, **fields):
    """A content block; every block of a list has the same fields, those not given are left out of the JSON."""
    empty = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), *[fields.get(n, empty).alias(n) for n in ("text", "thinking", "data", "content")])


def _messages(s, d):
    """Conversations as records: even ones have lists of blocks (a picture for every unit of turn % 6), odd ones a string."""
    text = F.coalesce("text", F.lit(""))
    pictures = F.array_repeat(_block("image"), (F.col("line") % 6).cast("int"))
    said = F.array(_block("text", text=text), _block("thinking", thinking=text), _block("tool_result", content=text), _block("redacted_thinking", data=F.lit("12345678")), _block("text", text=F.lit("tail")))
    rows = adapter.turns(s, d)
    listed = _parsed(rows.where("sid % 2 = 0"), F.struct(F.struct(F.concat(pictures, said).alias("content")).alias("message")), "sid", "line")
    plain = _parsed(rows.where("sid % 2 <> 0"), F.struct(F.struct(text.alias("content")).alias("message")), "sid", "line")
    return listed.unionByName(plain)


def _kinds(s, d):
    """Records of every kind: user lines in turn are results of tools, messages of others, machine prompts and genuine."""
    n = (F.col("sid") + F.col("line")) % 6
    mark = F.when(n == 1, "<teammate-message a>").when(n == 2, "<task-notification>").when(n == 3, "<x>").otherwise("")
    return adapter.turns(s, d).withColumns({"is_tool_result": n == 0, "is_meta": F.when(n == 4, True), "text": F.concat(mark, F.coalesce("text", F.lit("")))})


def _rollouts(s, d):
    """Documents as rows of rollout files: messages, calls, compactions and others in turn."""
    n = F.col("doc_id") % 5
    text = F.coalesce("text", F.lit(""))
    content = F.array(F.struct(text.alias("text")), F.struct(F.lit("end").alias("text")))
    payload = F.struct(
        F.when(n < 2, "message").when(n == 2, "function_call").otherwise("other").alias("type"),
        F.when(n == 0, "user").when(n == 1, "assistant").alias("role"),
        F.when(n < 2, content).alias("content"),
        F.when(n == 2, F.lit("spawn_agent")).alias("name"),
        F.when(n == 2, F.to_json(F.struct(F.col("source").alias("target"), text.alias("message")))).alias("arguments"),
    )
    record = F.struct(F.when(n == 3, "compacted").when(n == 4, "unknown").otherwise("response_item").alias("type"), payload.alias("payload"))
    return _parsed(_docs(s, d).withColumns({"path": F.concat(F.lit("/r/"), F.coalesce("source", F.lit(""))), "line_no": F.col("doc_id")}), record, "path", "line_no")


def _heads(s, d):
    """The first two rows of a rollout file for each document; those of every third tell a thread."""
    line = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = _docs(s, d).select("doc_id", F.concat(F.lit("/r/"), "doc_id").alias("path"), line.alias("line_no"))
    name = F.concat(F.lit("s"), "doc_id")
    source = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("review").alias("subagent")))
    payload = F.struct(name.alias("id"), F.when(F.col("doc_id") % 3 == 0, "t").alias("session_id"), source.alias("source"))
    return _parsed(rows, F.struct(F.when(F.col("line_no") == 1, "session_meta").otherwise("event_msg").alias("type"), payload.alias("payload")), "path", "line_no")


def _structured():
    """Texts with a fence, an open fence, a table and list lines: words with a vowel ahead stand on lines of their own."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), " ([aeiou])", "\n- $1")
    rest = F.when(F.col("doc_id") % 3 == 0, F.lit("```\nopen")).otherwise(F.lit(""))
    return F.concat(F.lit("```\n- x\n``` and\n| a | b |\n|---|:-:|\n| 1 | 2 |\n"), body, F.lit("\n"), rest)


STRUCTURED = (
    "structured AS (SELECT doc_id, '```' || chr(10) || '- x' || chr(10) || '``` and' || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' || chr(10) || regexp_replace(coalesce(text, ''), ' ([aeiou])', chr(10) || '- \\1', 'g') || chr(10) || "
    "CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || 'open' ELSE '' END AS text FROM documents)"
)


def _uuid(number):
    h = F.sha2(number.cast("string"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _named(s, d):
    """Sessions, one a document, whose texts name three before (one of them by its beginning), one after and themselves."""
    n = F.col("doc_id")
    every = _docs(s, d).select("doc_id", _uuid(n).alias("sid"), (n * 10).alias("first_ts"), (n * 10 + 5).alias("last_ts"))
    said = F.concat_ws(" ", F.lit("as in"), _uuid(n - 1), F.substring(_uuid(n - 2), 1, 8), _uuid(n - 3), _uuid(n + 1), _uuid(n))
    return sessions.named_sessions(every.select("sid", said.alias("text")), every.drop("doc_id"), 2)


def _restore_lines(s, d):
    """Lines of restores: reads name a session each, every fifth conversation has replies among them."""
    n = F.col("line") % 5
    kind = F.when(n == 0, "restore").when((F.col("sid") % 5 == 0) & (n == 2), "reply").when(n < 4, "read").otherwise("other")
    return adapter.turns(s, d).select("sid", "line", kind.alias("kind"), F.concat(F.lit("s"), (F.col("sid") + F.col("line")) % 7).alias("target"))


def _usage_lines(s, d):
    """Ledger rows of which purchases tell their usage and the others only an estimate."""
    told = F.when(F.col("event_type") == "purchase", F.col("input") + F.col("cc") + F.col("cr"))
    return settled(s, d).select("sid", "line", F.concat(F.lit("r"), F.floor(F.col("line") / 2)).alias("req"), told.alias("usage"), F.col("k").alias("estimate"))


def _compactions(s, d):
    return settled(s, d).select("model", "ts_s", (F.col("cr") + F.col("line") % 1000).alias("size"), F.lit(900_000).cast("long").alias("threshold"), (F.col("input") % 40 * 100).alias("quiet_s"))


def _prompts(s, d):
    rows = adapter.turns(s, d)
    return turns.row_to_turn(rows.where("role <> 'user'").select("sid", "line"), rows.where("role = 'user'").select("sid", "line", "text"))


def _journals(s, d):
    name = F.when(F.col("doc_id") % 4 == 0, "journal.jsonl").otherwise(F.concat(F.lit("agent-a"), "doc_id", F.lit(".jsonl")))
    return transcripts.drop_workflow_journals(_docs(s, d).select("doc_id", F.concat(F.lit("/p/x/s1/workflows/w"), "doc_id", F.lit("/"), name).alias("path")))


def _role_names(rows):
    return rows.withColumn("role", F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("Teammate"))


ROUGH = "floor(length(coalesce(text, '')) / 4.0::DOUBLE + 0.5)::BIGINT"


def _folded(text: str, over: int, head: int, tail: int) -> str:
    """SQL of F11 on an SQL text that is already stripped."""
    end = rf"|| ' ' || regexp_replace(right({text}, {tail}), '^\s+', '')" if tail else ""
    return rf"CASE WHEN length({text}) <= {over} THEN {text} ELSE regexp_replace(left({text}, {head}), '\s+$', '') || ' …[+' || (length({text}) - {head + tail}) || ' chars, read L{{n}} for the rest]' {end} END"


def _snapped(at: str, back_first: bool) -> str:
    """SQL of a cut of t (n characters) moved to white space at most five characters away."""
    one, other = ("-", "+") if back_first else ("+", "-")
    places = ", ".join([f"{at} {one} {k}" for k in range(6)] + [f"{at} {other} {k}" for k in range(1, 6)])
    return rf"coalesce(list_filter([{places}], lambda p: p >= 0 AND p < n AND regexp_matches(substr(t, p + 1, 1), '^\s$'))[1], {at})"


def _cut_twin(over: int, head: int, tail: int, note: str) -> str:
    ends = r"'^\s+|\s+$', '', 'g'"
    return f"CASE WHEN n <= {over} THEN t ELSE regexp_replace(substr(t, 1, {_snapped(str(head), True)}), {ends}) || {note} || regexp_replace(substr(t, {_snapped(f'(n - {tail})', False)} + 1), {ends}) END"


QUERIES = {
    "p5_content_text": (
        lambda s, d: _messages(s, d).select("sid", "line", transcripts.content_text(F.col("v")).alias("text")),
        "SELECT conv_id AS sid, turn AS line, CASE WHEN conv_id % 2 <> 0 THEN coalesce(text, '') WHEN coalesce(text, '') = '' THEN 'tail' ELSE text || ' tail' END AS text FROM conversations",
    ),
    "f9_block_tokens": (
        lambda s, d: _messages(s, d).select("sid", "line", exports.est_block_tokens(F.col("v")).alias("tokens")),
        f"SELECT conv_id AS sid, turn AS line, CASE WHEN conv_id % 2 <> 0 THEN {ROUGH} ELSE 3 * {ROUGH} + turn % 6 * 2000 + 3 END::BIGINT AS tokens FROM conversations",
    ),
    "f15_image_markers": (
        lambda s, d: _messages(s, d).select("sid", "line", exports.image_markers(F.col("v")).alias("marks")),
        "SELECT conv_id AS sid, turn AS line, CASE WHEN conv_id % 2 <> 0 THEN '' ELSE trim(repeat('[Image] ', least(turn % 6, 3)::INT)) || CASE WHEN turn % 6 > 3 THEN ' [+' || (turn % 6 - 3) || ' images]' ELSE '' END END AS marks FROM conversations",
    ),
    "p13_classify": (
        lambda s, d: _kinds(s, d).select("sid", "line", sessions.classify_record(F.col("role"), F.col("is_meta"), F.col("text"), F.col("is_tool_result")).alias("speaker")),
        r"""SELECT conv_id AS sid, turn AS line, CASE WHEN role = 'system' THEN 'System' WHEN role = 'user' THEN
            CASE (conv_id + turn) % 6 WHEN 1 THEN 'Teammate' WHEN 2 THEN 'Agent' WHEN 3 THEN 'Machine' WHEN 4 THEN 'Machine' WHEN 5 THEN CASE WHEN regexp_matches(coalesce(text, ''), '^\s*<[A-Za-z]') THEN 'Machine' ELSE 'User' END END
            WHEN role = 'assistant' AND ((conv_id + turn) % 6 BETWEEN 1 AND 3 OR regexp_matches(coalesce(text, ''), '\S')) THEN 'Assistant' END AS speaker FROM conversations""",
    ),
    "f12_truncate": (
        lambda s, d: _docs(s, d).select("doc_id", S.truncate_user(F.col("text")).alias("said"), S.truncate_reply(F.col("text")).alias("replied")),
        "WITH f AS (SELECT doc_id, "
        + STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")
        + " AS t, greatest(1, len(string_split(text, chr(10))) - 2) AS lines FROM documents), g AS (SELECT *, length(t) AS n FROM f) SELECT doc_id, "
        + _cut_twin(500, 300, 200, "' ..[' || lines || 'lines omitted].. '")
        + " AS said, "
        + _cut_twin(200, 100, 100, "' [...truncated...] '")
        + " AS replied FROM g",
    ),
    "f13_structure_counts": (
        lambda s, d: _docs(s, d).select("doc_id", S.structure_counts(_structured()).alias("c")).select("doc_id", "c.*"),
        rf"""WITH {STRUCTURED}, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM structured)
        SELECT doc_id, ((length(text) - length(replace(text, '```', ''))) // 3 // 2)::INT AS code,
          len(list_filter(lines, lambda x: contains(x, '---') AND regexp_matches(x, '^\s*\|?[\s:-]*\|[\s:|-]*\|?\s*$')))::INT AS "table",
          len(regexp_extract_all(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^\s*(?:[-*+]|[0-9]+\.)\s+') THEN 'i' ELSE '.' END), ''), 'iii+'))::INT AS list FROM l""",
    ),
    "f14_open_structures": (
        # an item has at most 500 characters: the twin hides longer ones from its pattern by a character in front
        lambda s, d: _docs(s, d).select("doc_id", S.abstract_structures(_structured()).alias("t")),
        rf"""WITH {STRUCTURED}, coded AS (SELECT doc_id, regexp_replace(text, '(?s)```.*?```', '[Code]', 'g') AS text FROM structured),
        hidden AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with(x, '- ') AND length(x) > 502 THEN chr(1) || x ELSE x END), chr(10)) AS text FROM coded)
        SELECT doc_id, replace(regexp_replace(regexp_replace(text, '(?m)^\|[^\n]+\|\n\|(?:\s*:?-+:?\s*\|){{2,}}\n(?:\|[^\n]+\|\n?)*', '[Table]', 'g'),
          '(?m)(?:^\s{{0,4}}(?:[-*+]|[0-9]+[.)])\s+[^\n]+(?:\n|\z)){{3,}}', '[List]', 'g'), chr(1), '') AS t FROM hidden""",
    ),
    "t6_normalize_codex": (
        lambda s, d: transcripts.normalize_codex(_rollouts(s, d)),
        "SELECT '/r/' || coalesce(source, '') AS path, doc_id AS line_no, (['user', 'assistant', 'tool', 'system', 'placeholder'])[1 + doc_id % 5] AS role, CASE WHEN doc_id % 5 < 2 THEN coalesce(text, '') || chr(10) || 'end' WHEN doc_id % 5 = 2 THEN 'spawn_agent' END AS text FROM documents",
    ),
    "t7_agent_messages": (
        lambda s, d: exports.agent_messages(_rollouts(s, d)),
        "SELECT '/r/' || coalesce(source, '') AS path, doc_id AS line_no, 'outgoing' AS direction, 'spawn_agent' AS kind, nullif(source, '') AS peer, text FROM documents WHERE doc_id % 5 = 2 AND text <> ''",
    ),
    "s9_codex_rollouts": (
        lambda s, d: transcripts.codex_rollouts(_heads(s, d)),
        "SELECT '/r/' || doc_id AS path, 's' || doc_id AS sid, CASE WHEN doc_id % 3 = 0 THEN 't' ELSE 's' || doc_id END AS thread, doc_id % 2 = 0 AS is_subagent FROM documents",
    ),
    "s5_workflow_journals": (lambda s, d: _journals(s, d).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0"),
    "t12_alert_lines": (
        lambda s, d: _alerts(s, d).select("sid", "turn", "kinds"),
        f"""WITH {COMMANDS},
        m AS (SELECT *, role = 'user' AND command IS NULL AS is_turn, CASE WHEN role = 'system' OR command = 'compact' THEN '+' WHEN command = 'reload' THEN '~' WHEN command = 'model' THEN '!' END AS marker FROM commands WHERE sid % 5 <> 0),
        g AS (SELECT *, min(line) FILTER (WHERE is_turn) OVER (PARTITION BY sid ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS turn FROM m),
        held AS (SELECT sid, turn, bool_or(marker = '+') AS c, bool_or(marker = '~') AS r, bool_or(marker = '!') AS o FROM g WHERE marker IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
        SELECT m.sid, m.line AS turn, CASE WHEN held.sid IS NOT NULL THEN concat_ws('+', CASE WHEN c THEN 'compact' END, CASE WHEN r THEN 'reload' END, CASE WHEN o THEN 'model' END)
          WHEN m.line = min(m.line) OVER (PARTITION BY m.sid) THEN 'start' ELSE '' END AS kinds
        FROM m LEFT JOIN held ON m.sid = held.sid AND m.line = held.turn WHERE m.is_turn""",
    ),
    "j20_named_sessions": (
        _named,
        """WITH h AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents), s AS (SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS sid FROM h),
        n AS (SELECT s.sid, o.sid AS named, o.doc_id FROM s CROSS JOIN (VALUES (-1), (-2), (-3), (1), (0)) k(step) JOIN s o ON substr(o.sid, 1, 8) = substr(sha256((s.doc_id + step)::VARCHAR), 1, 8) WHERE o.doc_id * 10 + 5 < s.doc_id * 10 AND o.sid <> s.sid)
        SELECT sid, named, (row_number() OVER (PARTITION BY sid ORDER BY doc_id DESC, named))::INT AS rank FROM n QUALIFY rank <= 2""",
    ),
    "w16_restore_sequences": (
        lambda s, d: sessions.restore_sequences(_restore_lines(s, d)).select("sid", "restore", F.array_join("read", "|").alias("read")),
        """WITH l AS (SELECT conv_id AS sid, turn AS line, CASE WHEN turn % 5 = 0 THEN 'restore' WHEN conv_id % 5 = 0 AND turn % 5 = 2 THEN 'reply' WHEN turn % 5 < 4 THEN 'read' ELSE 'other' END AS kind, 's' || ((conv_id + turn) % 7) AS target FROM conversations),
        g AS (SELECT *, sum((kind = 'restore')::INT) OVER (PARTITION BY sid ORDER BY line) AS grp FROM l),
        r AS (SELECT sid, grp, min(line) AS restore, min(line) FILTER (WHERE kind = 'reply') AS stop FROM g WHERE grp > 0 GROUP BY ALL)
        SELECT sid, restore, coalesce((SELECT string_agg(DISTINCT target, '|' ORDER BY target) FROM g WHERE g.sid = r.sid AND g.grp = r.grp AND kind = 'read' AND (stop IS NULL OR line < stop)), '') AS read FROM r""",
    ),
    "w35_context_size": (
        lambda s, d: sessions.context_size(_usage_lines(s, d)),
        sql(
            "SELECT a.sid, (a.usage + coalesce((SELECT sum(estimate) FROM l WHERE l.sid = a.sid AND l.line > a.anchor AND l.usage IS NULL), 0))::BIGINT AS context FROM last a",
            "l AS (SELECT sid, line, 'r' || (line // 2) AS req, CASE WHEN event_type = 'purchase' THEN input + cc + cr END AS usage, k AS estimate FROM settled)",
            "per AS (SELECT sid, req, arg_max(usage, line) AS usage, min(line) AS anchor, max(line) AS stop FROM l WHERE usage IS NOT NULL GROUP BY ALL)",
            "last AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY sid ORDER BY stop DESC) = 1)",
        ),
    ),
    "w36_observed_threshold": (
        lambda s, d: sessions.observed_threshold(_compactions(s, d)),
        sql("SELECT model, size FROM (SELECT model, cr + line % 1000 AS size, ts_s FROM settled WHERE input % 40 * 100 < 2700 QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts_s DESC, size DESC) = 1) WHERE size < 855000"),
    ),
    "w32_enclosing_prompt": (
        _prompts,
        "SELECT r.conv_id AS sid, r.turn AS line, u.turn AS turn, u.text AS prompt FROM (SELECT * FROM conversations WHERE role <> 'user') r ASOF LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u ON r.conv_id = u.conv_id AND r.turn >= u.turn",
    ),
    "t4_folded_texts": (
        lambda s, d: sessions.fold_segments(_role_names(adapter.turns(s, d)).withColumn("text", F.repeat("text", 4))).select("sid", "line", "text"),
        "SELECT sid, line, CASE WHEN role = 'user' THEN " + _folded("t", 500, 300, 200) + " WHEN role = 'assistant' THEN " + _folded("t", 200, 100, 100) + " ELSE " + _folded("t", 300, 300, 0) + " END AS text FROM (SELECT conv_id AS sid, turn AS line, role, " + STRIP.format("repeat(text, 4)") + " AS t FROM conversations)",
    ),
    "t9_dialogue_texts": (
        lambda s, d: sessions.abbreviated_dialogue(adapter.turns(s, d).withColumn("text", F.concat(F.lit("L1->L22->L"), "line", F.lit(" "), F.repeat("text", 4)))).select("sid", "run", "role", "line", "text"),
        "WITH c AS (SELECT conv_id AS sid, turn AS line, role, 'L1->L22->L' || turn || ' ' || repeat(text, 4) AS text FROM conversations), "
        "f AS (SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY sid ORDER BY line), true) AS fresh FROM c), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY sid ORDER BY line) AS run FROM f), "
        "j AS (SELECT sid, run, min(role) AS role, min(line) AS line, " + STRIP.format("regexp_replace(string_agg(text, chr(10) ORDER BY line), '(?:L[0-9]+->)+(L[0-9]+)', '\\1', 'g')") + " AS t FROM g GROUP BY sid, run) "
        "SELECT sid, run::BIGINT AS run, role, line, CASE WHEN role = 'user' THEN " + _folded("t", 500, 300, 200) + " ELSE " + _folded("t", 200, 100, 100) + " END AS text FROM j",
    ),
}


def _alerts(s, d):
    marked = restore.turn_markers(_commands(s, d).where("sid % 5 <> 0"))
    return exports.alert_lines(marked.select("sid", "turn"), marked.select("sid", "turn", "markers"))
