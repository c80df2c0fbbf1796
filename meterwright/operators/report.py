"""Report aggregates: profiles, buckets, densities, attribution, highlights and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import all_tokens, context_tokens

DAY = 86400
WEEK = 7 * DAY
#: Edges of the context buckets in tokens.
CONTEXT_EDGES = (250_000, 350_000, 500_000)


def _round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def day_of(ts: Column) -> Column:
    return F.floor(ts / DAY)


def span(rows: DataFrame) -> DataFrame:
    """First and last second, and calendar days: one row."""
    return rows.agg(F.min("ts_s").alias("t0"), F.max("ts_s").alias("t1")).withColumn("n_days", F.floor(F.col("t1") / DAY) - F.floor(F.col("t0") / DAY) + 1)


def hour_profile(rows: DataFrame, value: str = "cost_e8", scale_edges: bool = True, days_scaled: int = 14) -> DataFrame:
    """Per hour of the day the mean and maximum of active days and the mean over calendar days.

    In short periods the first and last partial hours are scaled up to full ones.
    """
    edge = F.broadcast(span(rows))  # one row
    cell = rows.groupBy(day_of(F.col("ts_s")).alias("day"), F.floor(F.col("ts_s") % DAY / 3600).alias("hour")).agg(F.sum(value).alias("v"))
    cell = cell.crossJoin(edge)
    first = (F.col("day") == F.floor(F.col("t0") / DAY)) & (F.col("hour") == F.floor(F.col("t0") % DAY / 3600))
    last = (F.col("day") == F.floor(F.col("t1") / DAY)) & (F.col("hour") == F.floor(F.col("t1") % DAY / 3600))
    m0, m1 = F.floor(F.col("t0") % 3600 / 60), F.greatest(F.floor(F.col("t1") % 3600 / 60), F.lit(1))
    # when both hold the first one counts; a last minute of 0 is taken as 1
    factor = F.when((F.col("n_days") > days_scaled) | F.lit(not scale_edges), 1.0).when(first & (m0 > 0), 60.0 / (60 - m0)).when(last, 60.0 / m1).otherwise(1.0)
    per = cell.withColumn("v", F.col("v") * factor).groupBy("hour").agg(F.sum("v").alias("total"), F.max("v").alias("most"), F.count(F.lit(1)).alias("days"))
    hours = edge.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"), "t0", "t1", "n_days")
    missing = (F.col("hour") < F.floor(F.col("t0") % DAY / 3600)).cast("int") + (F.col("hour") > F.floor(F.col("t1") % DAY / 3600)).cast("int")
    calendar = F.greatest(F.col("n_days") - missing, F.lit(1))
    got = hours.join(per, "hour", "left")
    value_of = lambda x: F.coalesce(F.floor(x + 0.5).cast("long"), F.lit(0))
    return got.select("hour", value_of(F.col("total") / F.col("days")).alias("mean"), value_of(F.col("most")).alias("most"), value_of(F.col("total") / calendar).alias("calendar_mean"))


def dow_profile(rows: DataFrame, value: str = "cost_e8") -> DataFrame:
    """Per weekday (Sunday 0) over seven-day buckets; partial first and last days of one weekday count as one."""
    edge = F.broadcast(span(rows))
    dow = lambda ts: (F.floor(ts / DAY) + 4) % 7
    cell = rows.groupBy(dow(F.col("ts_s")).alias("dow"), F.floor(F.col("ts_s") / WEEK).alias("week")).agg(F.sum(value).alias("v")).crossJoin(edge)
    same = dow(F.col("t0")) == dow(F.col("t1"))
    w0, w1 = F.floor(F.col("t0") / WEEK), F.floor(F.col("t1") / WEEK)
    merged = cell.withColumn("week", F.when(same & (F.col("dow") == dow(F.col("t0"))) & (F.col("week") == w0), w1).otherwise(F.col("week")))
    per = merged.groupBy("dow", "week").agg(F.sum("v").alias("v")).groupBy("dow").agg(F.sum("v").alias("total"), F.max("v").alias("most"), F.count(F.lit(1)).alias("weeks"))
    days = edge.select(F.explode(F.sequence(F.floor(F.col("t0") / DAY), F.floor(F.col("t1") / DAY))).alias("day"), same.alias("same"), dow(F.col("t0")).alias("d0"))
    calendar = days.groupBy(((F.col("day") + 4) % 7).alias("dow")).agg(F.count(F.lit(1)).alias("n"), F.first("same").alias("same"), F.first("d0").alias("d0"))
    calendar = calendar.select("dow", F.when(F.col("same") & (F.col("dow") == F.col("d0")) & (F.col("n") >= 2), F.col("n") - 1).otherwise(F.col("n")).alias("n"))
    every = edge.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("dow"))
    got = every.join(per, "dow", "left").join(calendar, "dow", "left")
    value_of = lambda x: F.coalesce(F.floor(x + 0.5).cast("long"), F.lit(0))
    return got.select("dow", value_of(F.col("total") / F.col("weeks")).alias("mean"), value_of(F.col("most")).alias("most"), value_of(F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("calendar_mean"))


def context_buckets(rows: DataFrame) -> DataFrame:
    """Calls by context size; the share is of all rows."""
    a, b, c = CONTEXT_EDGES
    x = context_tokens()
    bucket = F.when(x < a, "<250K").when(x < b, "250-350K").when(x < c, "350-500K").otherwise(">500K")
    per = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost_e8").alias("cost_e8"))
    return per.withColumn("share", _round2(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())))  # four rows


def dominant_component(rows: DataFrame) -> DataFrame:
    """Which component costs most in each call; ties go to input, output, write, read. Needs the rates on the rows."""
    parts = {"input": F.col("input") * F.col("r_input"), "output": F.col("out") * F.col("r_out"), "cacheCreate": F.col("cc5m") * F.col("r_cc5m") + F.col("cc1h") * F.col("r_cc1h"), "cacheRead": F.col("cr") * F.col("r_cr")}
    most = F.greatest(*parts.values())
    name = F.coalesce(*[F.when(v == most, F.lit(k)) for k, v in parts.items()])
    return rows.where(context_tokens() > 0).groupBy(name.alias("component")).agg(F.count(F.lit(1)).alias("n"))


def grid_density(points: DataFrame, n: int = 100, keys: list[str] = ()) -> DataFrame:
    """Points (x, y, model, text) in n x n cells, of each key on its own; cells at the upper edge have number n."""
    edge = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = points.join(F.broadcast(edge), list(keys)) if keys else points.crossJoin(F.broadcast(edge))  # a row for each key
    width = F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0")).otherwise(1.0) / n
    height = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0")).otherwise(0.01) / n
    cells = both.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / width)).withColumn("cy", F.floor((F.col("y") - F.col("y0")) / height))
    per_model = cells.groupBy(*keys, "cx", "cy", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )
    out = per_model.groupBy(*keys, "cx", "cy").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.max_by("model", F.struct("n", "model")).alias("model")
    )
    radius = F.when(F.col("n") <= 1, 2).when(F.col("n") <= 5, 4).when(F.col("n") <= 20, 7).otherwise(10)
    return out.select(*keys, "cx", "cy", "n", F.round(F.col("sx") / F.col("n")).cast("long").alias("x"), F.round(F.col("sy") / F.col("n"), 4).alias("y"), "y_min", "y_max", radius.alias("radius"), "model")


def top_texts(points: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k dearest texts of each group, by rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("y"), "text", "line")
    return points.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def linear_trend(points: DataFrame) -> DataFrame:
    """Least squares; null when x does not vary."""
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def attribution(rows: DataFrame, role: Column) -> DataFrame:
    """Main sessions against agents, agents by role and by model, in long form."""
    kind = F.when(F.col("parent").isNull(), "main").otherwise("agents")
    named = rows.withColumns({"kind": kind, "role": F.when(kind == "agents", F.coalesce(role, F.lit("unknown"))), "agent_model": F.when(kind == "agents", F.col("model"))})
    parts = F.explode(
        F.array_compact(
            F.array(
                F.struct(F.lit("all").alias("level"), F.lit("all").alias("name")),
                F.struct(F.lit("kind").alias("level"), F.col("kind").alias("name")),
                F.when(F.col("kind") == "agents", F.struct(F.lit("role").alias("level"), F.col("role").alias("name"))),
                F.when(F.col("kind") == "agents", F.struct(F.lit("model").alias("level"), F.col("agent_model").alias("name"))),
            )
        )
    )
    each = named.select("sid", "input", "out", "cc", "cr", "cost_e8", parts.alias("p"))
    return each.groupBy("p.level", "p.name").agg(
        F.sum(F.col("input") + F.col("out") + F.col("cc") + F.col("cr")).alias("total"), F.sum("cost_e8").alias("cost_e8"), F.count_distinct("sid").alias("sessions")
    )


def attribution_integrity(parts: DataFrame) -> DataFrame:
    """Levels whose parts do not add up to the whole; empty if all is well."""
    at = lambda level, name=None: F.sum(F.when((F.col("level") == level) & (F.lit(name is None) | (F.col("name") == name)), F.col("total")).otherwise(0))
    sums = parts.agg(at("all").alias("whole"), at("kind").alias("kinds"), at("kind", "agents").alias("agents"), at("role").alias("roles"), at("model").alias("models"))
    checks = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(a).alias("expected"), F.col(b).alias("got")) for n, a, b in (("kind", "whole", "kinds"), ("role", "agents", "roles"), ("model", "agents", "models"))]))
    return sums.select(checks.alias("c")).select("c.*").where("expected <> got")


def before_after(rows: DataFrame, day: int) -> DataFrame:
    """Mean cost of a day and tokens per output before and from a day on; days with 1000 output tokens or more count for the ratio."""
    per = rows.groupBy(day_of(F.col("ts_s")).alias("day")).agg(F.sum("cost_e8").alias("cost_e8"), F.sum(all_tokens()).alias("tokens"), F.sum("out").alias("out"))
    side = F.when(F.col("day") < day, "before").otherwise("after")
    out = per.groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("days"),
        F.floor(F.avg("cost_e8") + 0.5).cast("long").alias("day_cost_e8"),
        F.sum(F.when(F.col("out") >= 1000, F.col("tokens"))).alias("tokens"),
        F.sum(F.when(F.col("out") >= 1000, F.col("out"))).alias("out"),
    )
    both = F.count(F.lit(1)).over(Window.partitionBy()) == 2
    return out.withColumn("_both", both).where("_both").drop("_both")


def seven_day_chunks(rows: DataFrame) -> DataFrame:
    """Active days in chunks of seven."""
    per = rows.groupBy(day_of(F.col("ts_s")).alias("day")).agg(F.sum("cost_e8").alias("cost_e8"))
    nth = F.row_number().over(Window.orderBy("day"))  # one row a day
    return per.withColumn("chunk", F.floor((nth - 1) / 7)).groupBy("chunk").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"), F.sum("cost_e8").alias("cost_e8"))


def monthly_projection(rows: DataFrame, most_days: int = 15) -> DataFrame:
    """Thirty days at the period's rate, for short periods only."""
    per = rows.agg(F.sum("cost_e8").alias("cost_e8")).crossJoin(span(rows).select("n_days"))
    return per.withColumn("month_e8", F.when(F.col("n_days") <= most_days, F.floor(F.col("cost_e8") * 30 / F.col("n_days")).cast("long")))


def batch_groups(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Two or more sessions whose first messages differ in digits only."""
    masked = F.regexp_replace(F.substring("first_text", 1, 80), r"\d+", "#")
    return sessions.groupBy(*keys, masked.alias("pattern")).agg(F.count_distinct("sid").alias("sessions")).where("sessions >= 2")


def top_sessions(rows: DataFrame, k: int = 15) -> DataFrame:
    """O3: the dearest sessions; ties by id."""
    return rows.groupBy("sid").agg(F.sum("cost_e8").alias("cost_e8")).orderBy(F.desc("cost_e8"), "sid").limit(k)


def event_counts(rows: DataFrame) -> DataFrame:
    """Rows by tag."""
    return rows.select(F.explode("evt").alias("tag"), "sid").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("sessions"))


def thinking_rate(rows: DataFrame) -> DataFrame:
    """Share of thinking calls by model, agent and effort, and their totals."""
    sets = rows.cube("model", "is_agent", "effort").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_thinking").cast("int")).alias("thinking"), F.grouping_id().alias("level"))
    return sets.withColumn("rate", _round2(100.0 * F.col("thinking") / F.col("n")))


def output_per_call(rows: DataFrame) -> DataFrame:
    """Mean output of calls that did not think."""
    return rows.where("not has_thinking").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("out"))


def cache_read_share(rows: DataFrame) -> DataFrame:
    """Cost of cache reads over all cost; needs the rates on the rows."""
    return rows.agg(F.sum(F.col("cr") * F.col("r_cr")).alias("read_e8"), F.sum("cost_e8").alias("cost_e8"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: int = 0) -> DataFrame:
    """Rows where two derivations of the same table differ by more than the tolerance, or only one has them."""
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"{v}_other") for v in values])
    on = [left[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    both = left.select(*keys, *values).join(b, on, "full")
    apart = [F.abs(F.coalesce(v, F.lit(0)) - F.coalesce(f"{v}_other", F.lit(0))) > tolerance for v in values]
    differs = apart[0]
    for x in apart[1:]:
        differs = differs | x
    return both.where(differs).select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *values, *[f"{v}_other" for v in values])


def limit_window_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per window: sums, requests, sessions, peak concurrency and context, active minutes, models."""
    second = rows.groupBy(*keys, "win", "ts_s").agg(F.count_distinct("sid").alias("n"))
    peak = second.groupBy(*keys, "win").agg(F.max("n").alias("peak_sessions"))
    whole = rows.groupBy(*keys, "win").agg(
        F.sum("input").alias("input"),
        F.sum("out").alias("output"),
        F.sum("cc").alias("cache_write"),
        F.sum("cr").alias("cache_read"),
        _round2(F.sum("cost_e8") / 1e8).alias("cost"),
        F.count(F.lit(1)).alias("requests"),
        F.count_distinct("sid").alias("sessions"),
        F.max("cr").alias("peak_context"),
        F.floor((F.max("ts_s") - F.min("ts_s")) / 60 + 0.5).cast("long").alias("active_minutes"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )
    return whole.join(peak, [*keys, "win"])


def limit_total_row(rows: DataFrame, key: str) -> DataFrame:
    """Windows and a total; a session in two windows counts once in the total."""
    return rows.rollup(key).agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("sid").alias("sessions"), F.sum("cost_e8").alias("cost_e8"))


def window_usage(rows: DataFrame, windows: DataFrame, bucket: int = 300) -> DataFrame:
    """Usage of windows that may overlap, those of [start, active_end), by lane and start.

    Time is cut into buckets. In one that a window begins or ends in, rows are summed by session and second; in all others,
    which every window covers whole or not at all, by session only. The windows are given to the buckets that
    they touch and joined by equality, so what is multiplied by overlapping windows are sums, never rows. Rows
    without a time are in no window, a window without a row gives none, and an empty one (active_end <= start) holds nothing.
    """
    windows = windows.select("lane", "start", "active_end").where("active_end > start")
    of = lambda t: F.floor(t / bucket).cast("long")
    ends = F.array(F.when(F.col("start") % bucket != 0, of(F.col("start"))), F.when(F.col("active_end") % bucket != 0, of(F.col("active_end"))))
    edges = windows.select(F.explode(F.array_compact(ends)).alias("_b")).distinct().withColumn("_edge", F.lit(True))
    slim = rows.where("ts_s is not null").select(of(F.col("ts_s")).alias("_b"), "ts_s", "sid", "cost_e8", all_tokens().alias("tokens"))
    sums = slim.join(edges, "_b", "left").groupBy("_b", "sid", F.when(F.col("_edge"), F.col("ts_s")).alias("_at")).agg(
        F.sum("cost_e8").alias("cost_e8"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests")
    )
    spread = windows.withColumn("_b", F.explode(F.sequence(of(F.col("start")), of(F.col("active_end") - 1))))
    near = sums.join(spread, "_b").where("_at is null or (_at >= start and _at < active_end)")
    return near.groupBy("lane", "start").agg(F.sum("cost_e8").alias("cost_e8"), F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"), F.count_distinct("sid").alias("sessions"))


def private_view(rows: DataFrame, ids: list[str], texts: list[str]) -> DataFrame:
    """Ids renamed consistently, texts blanked."""
    renamed = {c: F.concat(F.lit(f"{c}-"), F.substring(F.sha2(F.col(c), 256), 1, 8)) for c in ids}
    return rows.withColumns({**renamed, **{c: F.lit("") for c in texts}})
