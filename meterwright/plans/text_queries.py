"""Queries that apply the text functions and predicates to the text tables, and the counter operators to their stand-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import counters
from ..sources import transcripts
from . import adapter
from .adapter import sql


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def _turns(spark, d):
    return adapter.turns(spark, d)


def _tagged():
    """Texts with tags put in; every third document."""
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<system-reminder>a\nb</system-reminder>"), "text", F.lit("<command-message>x</command-message> \n"))).otherwise(F.col("text"))


TAGGED = "CASE WHEN doc_id % 3 = 0 THEN '<system-reminder>a' || chr(10) || 'b</system-reminder>' || text || '<command-message>x</command-message> ' || chr(10) ELSE text END"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ASCII = r"length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))"


def _messages():
    """Limit messages of every kind."""
    kinds = F.array(*map(F.lit, ["You've hit your session limit", "You've used your Weekly limit", "Opus limit reached", "sonnet limit", "You're out of extra usage", "hello"]))
    base = F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int"))
    return F.when(F.col("doc_id") % 2 == 0, F.concat(base, F.lit(" · resets 10:30am (Asia/Seoul)"))).otherwise(F.concat(base, F.lit(" · resets 1am")))


MESSAGES = "(['You''ve hit your session limit', 'You''ve used your Weekly limit', 'Opus limit reached', 'sonnet limit', 'You''re out of extra usage', 'hello'])[1 + doc_id % 6] || CASE WHEN doc_id % 2 = 0 THEN ' · resets 10:30am (Asia/Seoul)' ELSE ' · resets 1am' END"


def _counters(spark, d):
    ev = adapter.events(spark, d)
    order = Window.partitionBy("user_id").orderBy("ts_s", "event_id")
    part = F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).over(order)
    ev = ev.withColumn("part", part)
    step = F.when(F.col("k") == 0, 0).otherwise(F.col("iv"))
    total = F.sum(step).over(Window.partitionBy("user_id", "part").orderBy("ts_s", "event_id"))
    ev = ev.withColumn("t", total)
    return ev.select(
        F.concat(F.lit("s"), "user_id").alias("sid"),
        "ts_s",
        F.struct("ts_s", "event_id").alias("line"),
        F.when(F.col("k") != 1, F.struct(F.col("t").alias("input"), (2 * F.col("t")).alias("output"))).alias("total"),
        F.struct(F.col("iv").alias("input"), (2 * F.col("iv")).alias("output")).alias("last"),
        "event_id",
        "k",
    )


COUNTERS = [
    "c0 AS (SELECT *, sum((k = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS part FROM ev)",
    "c1 AS (SELECT *, sum(CASE WHEN k = 0 THEN 0 ELSE iv END) OVER (PARTITION BY user_id, part ORDER BY ts_s, event_id) AS t FROM c0)",
    "c2 AS (SELECT *, CASE WHEN k <> 1 THEN t END AS total FROM c1)",
    "c3 AS (SELECT *, last_value(total IGNORE NULLS) OVER w AS p, coalesce(lag((total IS NOT NULL)::INT) OVER (PARTITION BY user_id ORDER BY ts_s, event_id), 1) AS after_valid FROM c2 WINDOW w AS (PARTITION BY user_id ORDER BY ts_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "c4 AS (SELECT 's' || user_id AS sid, event_id, ts_s, CASE WHEN total IS NULL THEN CASE WHEN after_valid = 1 THEN iv ELSE 0 END WHEN p IS NULL OR total < p THEN least(iv, total) ELSE total - p END AS delta_input, CASE WHEN total IS NULL THEN CASE WHEN after_valid = 1 THEN 'missing_total_fallback' ELSE 'missing_total_suppressed' END WHEN total < p THEN 'counter_reset' END AS diagnostic FROM c3)",
]
SAMPLES = "samples AS (SELECT 's' || user_id AS sid, event_id AS line, ts_s, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS lane, 'main' AS limit_id, (k + 1)::DOUBLE AS used_percent, 300 AS window_minutes, (ts_s // 18000 + 1) * 18000 + event_id % 7 AS resets_at FROM ev WHERE event_type = 'view')"


def _limit_log(spark, d):
    return adapter.limit_samples(spark, d).select("sid", "line", "ts_s", F.col("used_percent").alias("pct_5h"), F.col("resets_at").alias("reset_5h"))


def _deltas(spark, d):
    return counters.counter_delta(_counters(spark, d), ["input", "output"])


def _on_docs(columns):
    """A query of named columns; they are made when it runs, as columns need a session."""
    return lambda s, d: _docs(s, d).select("doc_id", *[c.alias(n) for n, c in columns().items()])


def _events(spark, d):
    return adapter.events(spark, d)


QUERIES = {
    "f2_account_hash": (_on_docs(lambda: dict(h=S.account_hash(F.concat(F.lit(" "), "source", F.lit("@X.com "))))), "SELECT doc_id, substr(sha256(lower(trim(' ' || source || '@X.com '))), 1, 12) AS h FROM documents"),
    "f3_short_hash": (_on_docs(lambda: dict(h=S.short_hash(F.col("text")), r=S.redact("session", F.col("source")))), "SELECT doc_id, substr(sha256(text), 1, 8) AS h, 'session-' || substr(sha256(source), 1, 8) AS r FROM documents"),
    "f4_context_tokens": (
        lambda s, d: adapter.settled(s, d).select("sid", "req", (F.col("input") + F.col("cc") + F.col("cr")).alias("context"), (F.col("input") + F.col("cc") + F.col("cr") + F.col("out")).alias("tokens")),
        sql("SELECT sid, req, input + cc + cr AS context, input + cc + cr + out AS tokens FROM settled"),
    ),
    "f5_fmt_tokens": (
        lambda s, d: adapter.settled(s, d).select("sid", "req", S.fmt_tokens(F.col("cr") + F.col("input")).alias("label")),
        sql(r"SELECT sid, req, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN regexp_replace(printf('%.1f', floor(n / 100.0 + 0.5) / 10), '\.0$', '') || 'K' ELSE regexp_replace(printf('%.1f', floor(n / 100000.0 + 0.5) / 10), '\.0$', '') || 'M' END AS label FROM (SELECT *, cr + input AS n FROM settled)"),
    ),
    "f6_round2": (lambda s, d: adapter.settled(s, d).select("sid", "req", S.round2(F.col("cost_e8") / 1e8).alias("usd")), sql("SELECT sid, req, floor(cost_e8 / 1e8 * 100 + 0.5) / 100 AS usd FROM settled")),
    "f7_labels": (lambda s, d: adapter.settled(s, d).select("sid", "req", S.date_key(F.col("ts_s")).alias("day"), S.time_label(F.col("ts_s")).alias("time")), sql("SELECT sid, req, strftime(to_timestamp(ts_s), '%Y-%m-%d') AS day, strftime(to_timestamp(ts_s), '%H:%M') AS time FROM settled")),
    "f8_est_tokens": (
        _on_docs(lambda: dict(a=S.est_tokens_a(F.col("text")), b=S.est_tokens_b(F.col("text")))),
        f"SELECT doc_id, ceil(n / 4.0::DOUBLE + (length(text) - n) / 1.5::DOUBLE)::BIGINT AS a, ceil(n / 2.1::DOUBLE + (length(text) - n) * 1.35::DOUBLE)::BIGINT AS b FROM (SELECT *, {ASCII} AS n FROM documents)",
    ),
    "f10_script_scale": (
        # texts whose vowels are written in dense scripts, in every second document
        lambda s, d: _docs(s, d).select("doc_id", S.script_scale(F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aeiou", "漢かカ한ก")).otherwise(F.col("text"))).alias("scale")),
        r"""WITH t AS (SELECT doc_id, regexp_replace(left(CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeiou', '漢かカ한ก') ELSE text END, 2000), '\s', '', 'g') AS seen FROM documents)
        SELECT doc_id, CASE WHEN length(seen) > 0 AND length(regexp_replace(seen, '[^漢かカ한ก]', '', 'g')) / length(seen)::DOUBLE >= 0.2 THEN 2 / 3::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM t""",
    ),
    "f11_fold": (
        _on_docs(lambda: dict(t=S.fold(F.col("text"), 500, 300, 200))),
        r"SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE regexp_replace(left(t, 300), '\s+$', '') || ' …[+' || (length(t) - 500) || ' chars, read L{n} for the rest] ' || regexp_replace(right(t, 200), '^\s+', '') END AS t FROM (SELECT doc_id, " + STRIP.format("text") + " AS t FROM documents)",
    ),
    "f14_structures": (
        _on_docs(lambda: dict(t=S.abstract_structures(F.concat(F.lit("```\ncode\n``` \n- a\n- b\n- c\n"), "text")))),
        None,  # a repeated group of bounded repetitions is more than RE2 takes; held by a fixture test
    ),
    "f16_project_key": (lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", S.project_key(F.col("url")).alias("key")), "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g') AS key FROM pages"),
    "f17_badge": (
        lambda s, d: _events(s, d).select("event_id", S.badge(F.array_compact(F.array(F.when(F.col("k") > 80, "cost_danger").when(F.col("k") > 60, "cost_warn"), F.when(F.col("k") % 7 == 0, "ctx_warn"), F.when(F.col("k") % 5 == 0, "heuristic_resume"))), F.when(F.col("k") % 3 == 0, F.concat(F.lit("limit_hit_weekly"), F.lit("{1am}")))).alias("badge")),
        sql("SELECT event_id, CASE WHEN k > 80 THEN '**' WHEN k > 60 THEN '*' ELSE '' END || CASE WHEN k % 7 = 0 THEN '#' ELSE '' END || CASE WHEN k % 5 = 0 THEN '?' ELSE '' END || CASE WHEN k % 3 = 0 THEN '%W' ELSE '' END AS badge FROM ev"),
    ),
    "f18_mask_digits": (_on_docs(lambda: dict(t=S.mask_digits(F.col("text")))), "SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS t FROM documents"),
    "f19_model_family": (lambda s, d: adapter.settled(s, d).groupBy(S.model_family(F.col("model")).alias("family")).agg(F.count(F.lit(1)).alias("n")), sql("SELECT CASE WHEN model LIKE '%haiku%' THEN 'H' WHEN model LIKE '%sonnet%' THEN 'S' ELSE 'O' END AS family, count(*)::BIGINT AS n FROM settled GROUP BY 1")),
    "f20_plan_key": (
        lambda s, d: _docs(s, d).select("doc_id", S.plan_key(F.when(F.col("doc_id") % 2 == 0, "pro").otherwise(F.col("source"))).alias("p")).select("doc_id", "p.key", "p.raw"),
        "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pro' ELSE 'unknown' END AS key, CASE WHEN doc_id % 2 = 0 THEN 'pro' ELSE source END AS raw FROM documents",
    ),
    "f21_fmt_span": (lambda s, d: _events(s, d).select("event_id", S.fmt_span(F.col("k") * 30).alias("span")), sql("SELECT event_id, CASE WHEN m % 1440 = 0 THEN (m // 1440) || 'd' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE m || 'min' END AS span FROM (SELECT event_id, k * 30 AS m FROM ev)")),
    "f22_boilerplate": (
        _on_docs(lambda: dict(t=S.strip_boilerplate(F.concat(F.lit("✅ Used: x\n<command-args>a\nb</command-args>\n\n\n\n"), "text")))),
        "SELECT doc_id, " + STRIP.format(r"regexp_replace(chr(10) || chr(10) || chr(10) || text, '\n{3,}', chr(10) || chr(10), 'g')") + " AS t FROM documents",
    ),
    "f23_threshold": (
        lambda s, d: _events(s, d).select("event_id", S.compact_threshold(F.col("iv") * 1000 + 100000, F.lit(32000), F.col("k").cast("double")).alias("threshold")),
        sql("SELECT event_id, CASE WHEN k > 0 THEN least(floor((iv * 1000 + 80000) * (k / 100.0::DOUBLE))::BIGINT, iv * 1000 + 67000) ELSE iv * 1000 + 67000 END AS threshold FROM ev"),
    ),
    "p6_strip_tags": (lambda s, d: _docs(s, d).select("doc_id", S.strip_tags(_tagged()).alias("t")), "SELECT doc_id, " + STRIP.format("text") + " AS t FROM documents"),
    "p7_genuine_user": (
        lambda s, d: _turns(s, d).select("sid", "line", P.is_genuine_user(F.when(F.col("line") % 4 == 0, F.concat(F.lit("[User x] "), "text")).otherwise(F.col("text"))).alias("genuine")),
        "SELECT conv_id AS sid, turn AS line, turn % 4 <> 0 AND length(text) > 0 AS genuine FROM conversations",
    ),
    "p9_programmatic": (
        lambda s, d: _programmatic(s, d),
        "SELECT conv_id AS sid, n = 1 AND (f IS NULL OR f = '' OR f LIKE 'Read the %') AS programmatic FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n, CASE WHEN conv_id % 2 = 0 THEN 'Read the ' ELSE '' END || arg_min(text, turn) FILTER (WHERE role = 'user') AS f FROM conversations GROUP BY conv_id)",
    ),
    "p15_compact_agent": (lambda s, d: adapter.settled(s, d).withColumn("sid", F.when(F.col("line") % 3 == 0, F.concat(F.lit("agent-acompact-"), "line")).otherwise(F.col("sid"))).groupBy(P.is_compact_agent(F.col("sid")).alias("compact")).agg(F.count(F.lit(1)).alias("n")), sql("SELECT line % 3 = 0 AS compact, count(*)::BIGINT AS n FROM settled GROUP BY 1")),
    "p16_limit_type": (
        lambda s, d: _docs(s, d).select("doc_id", P.limit_type(_messages()).alias("kind")),
        "SELECT doc_id, (['limit_hit_5h', 'limit_hit_weekly', 'limit_hit_opus', 'limit_hit_sonnet', 'limit_hit_extra', 'limit_hit_unknown'])[1 + doc_id % 6] AS kind FROM documents",
    ),
    "p17_parse_reset": (lambda s, d: _docs(s, d).select("doc_id", P.parse_reset(_messages()).alias("reset")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{10:30am@Asia/Seoul}' ELSE '{1am}' END AS reset FROM documents"),
    "p18_limit_message": (lambda s, d: _docs(s, d).select("doc_id", P.is_limit_message(F.col("doc_id") % 10 == 0, _messages()).alias("limit")), f"SELECT doc_id, doc_id % 10 = 0 OR starts_with(m, 'You''ve hit your') OR starts_with(m, 'You''ve used') OR starts_with(m, 'You''re out of extra usage') AS \"limit\" FROM (SELECT doc_id, {MESSAGES} AS m FROM documents)"),
    "p21_machine_prompt": (lambda s, d: _docs(s, d).select("doc_id", P.is_machine_prompt(_tagged()).alias("machine")), rf"SELECT doc_id, regexp_matches({TAGGED}, '^\s*<[A-Za-z]') AS machine FROM documents"),
    "p1_period_cutoff": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", P.period_cutoff(F.col("o_orderdate").cast("date"), months=1).cast("string").alias("month_before"), P.period_cutoff(F.col("o_orderdate").cast("date"), days=7).cast("string").alias("week_before")),
        "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_before, CAST(CAST(o_orderdate AS DATE) - 7 AS VARCHAR) AS week_before FROM orders",
    ),
    "w9_counter_delta": (lambda s, d: _deltas(s, d).select("sid", "event_id", "delta_input", "delta_output", "diagnostic"), sql("SELECT sid, event_id, delta_input::BIGINT AS delta_input, 2 * delta_input::BIGINT AS delta_output, diagnostic FROM c4", *COUNTERS)),
    "w10_delta_row": (
        lambda s, d: counters.delta_row(_deltas(s, d).withColumn("delta_cached", F.col("k") * 10)).select("sid", "event_id", "fresh", F.array_join("diagnostics", "|").alias("diagnostics")),
        sql("SELECT c4.sid, c4.event_id, greatest(delta_input - k * 10, 0)::BIGINT AS fresh, concat_ws('|', CASE WHEN k * 10 > delta_input THEN 'cached_exceeds_input' END, diagnostic) AS diagnostics FROM c4 JOIN ev USING (event_id)", *COUNTERS),
    ),
    "w11_fill_model": (
        lambda s, d: counters.filled(adapter.settled(s, d).withColumn("model", F.when(F.col("line") % 4 == 0, F.col("model"))), "model").select("sid", "req", "model"),
        sql("SELECT sid, req, last_value(CASE WHEN line % 4 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM settled"),
    ),
    "s7_sparse_ledger": (
        lambda s, d: counters.sparse(adapter.settled(s, d), "model").groupBy("sid").agg(F.count("model").alias("written"), F.count(F.lit(1)).alias("n")),
        sql("SELECT sid, count(*) FILTER (WHERE fresh)::BIGINT AS written, count(*)::BIGINT AS n FROM (SELECT sid, coalesce(model <> lag(model) OVER (PARTITION BY sid ORDER BY line), true) AS fresh FROM settled) GROUP BY sid"),
    ),
    "s8_ratelimit_log": (
        lambda s, d: transcripts.dense_log(counters.sparse(_limit_log(s, d), "reset_5h", order=["ts_s", "line"]), ("reset_5h",)).select("sid", "line", "pct_5h", "reset_5h"),
        sql("SELECT sid, line, used_percent AS pct_5h, resets_at AS reset_5h FROM samples", SAMPLES),
    ),
    "s6_sparse_read": (
        lambda s, d: counters.filled(counters.sparse(adapter.settled(s, d), "model"), "model").select("sid", "req", "model"),
        sql("SELECT sid, req, model FROM settled"),
    ),
    "a36_session_totals": (lambda s, d: counters.session_totals(_deltas(s, d), ["input", "output"]), sql("SELECT sid, sum(delta_input)::BIGINT AS input, 2 * sum(delta_input)::BIGINT AS output, count(*)::BIGINT AS rows FROM c4 GROUP BY sid", *COUNTERS)),
    "a38_merge_samples": (
        lambda s, d: counters.merge_limit_samples(adapter.limit_samples(s, d)).drop("owner", "limit_id"),
        sql("SELECT lane, window_minutes::BIGINT AS window_minutes, resets_at, arg_max(used_percent, (ts_s, line, sid)) AS used_percent, max(ts_s) AS ts_s, count(DISTINCT sid)::BIGINT AS sessions FROM samples GROUP BY lane, window_minutes, resets_at", SAMPLES),
    ),
    "a39_canonical_limits": (
        lambda s, d: counters.canonical_limits(adapter.limit_samples(s, d)).select("lane", "sid", "line", "used_percent"),
        sql("SELECT lane, sid, line, used_percent FROM samples QUALIFY row_number() OVER (PARTITION BY lane ORDER BY ts_s DESC, line DESC) = 1", SAMPLES),
    ),
    "a40_longest_lane": (
        lambda s, d: counters.longest_lane(adapter.limit_samples(s, d).withColumn("window_minutes", F.when(F.col("lane") == "primary", 300).otherwise(10080))),
        sql("SELECT limit_id, 'secondary' AS lane, 10080 AS window_minutes FROM samples GROUP BY limit_id", SAMPLES),
    ),
    "a37_credits": (
        lambda s, d: _credits(s, d),
        sql("SELECT 'lower_bound' AS status, round(sum(CASE event_id % 3 WHEN 0 THEN iv * 100 + k * 10 + 2 * iv * 500 WHEN 1 THEN iv * 125 + k * 12.5 + 2 * iv * 750 ELSE 0 END) / 1e6, 6) AS credits, sum(3 * iv + k)::BIGINT AS eligible, sum(CASE WHEN event_id % 3 < 2 THEN 3 * iv + k END)::BIGINT AS covered FROM ev"),
    ),
}


def _programmatic(spark, d):
    users = _turns(spark, d).groupBy("sid").agg(F.count_if(F.col("role") == "user").alias("n"), F.min_by("text", F.when(F.col("role") == "user", F.col("line"))).alias("f"))
    first = F.concat(F.when(F.col("sid") % 2 == 0, "Read the ").otherwise(""), F.col("f"))
    return users.select("sid", P.is_programmatic(F.lit(False), F.col("n"), first).alias("programmatic"))


def _credits(spark, d):
    from ..operators import pricing

    card = spark.createDataFrame([(k, *map(float, v)) for k, v in pricing.CREDITS.items()], "id string, fresh double, cached double, output double")
    model = F.when(F.col("event_id") % 3 == 0, "gpt-5.6-sol").when(F.col("event_id") % 3 == 1, "gpt-5.5").otherwise("other")
    rows = _events(spark, d).select(model.alias("model"), F.col("iv").alias("fresh"), F.col("k").alias("cached"), (2 * F.col("iv")).alias("output"), F.lit(0).alias("written"))
    return counters.credit_equivalent(rows, card, pricing.CREDITS_PER_USD).select("status", F.round("credits", 6).alias("credits"), "eligible", "covered")
