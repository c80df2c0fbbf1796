"""Streams against their batch twins, on files that are read to the end."""

import pytest
from pyspark.sql import functions as F

from meterwright.operators import counters, ledger, limits, windows
from meterwright.streaming import jobs


@pytest.fixture
def stream(spark, tmp_path):
    """Writes a table as files, each a micro-batch, and opens it as a stream."""

    def open_stream(df, parts=3):
        source = str(tmp_path / "in")
        rows = df.orderBy("ts_s").collect()
        step = -(-len(rows) // parts)
        for k in range(parts):
            spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(source)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)

    return open_stream


@pytest.fixture
def run(tmp_path):
    def to_end(df):
        return jobs.run_to_end(df, str(tmp_path / "out"), str(tmp_path / "check")).collect()

    return to_end


def test_limit_log(spark, stream, run):
    log = spark.createDataFrame([("s", n, 100 + n, float(p), 5000 if n % 2 else None) for n, p in enumerate([10, 10, 75, 75, 95, 60, 92])], "sid string, line long, ts_s long, pct_5h double, reset_5h long")
    got = run(jobs.limit_log_stream(stream(log, 1)))
    batch = limits.crossing_alert(limits.change_dedup(log, ["pct_5h"])).collect()
    assert sorted((r.line, r.alert or "") for r in got) == sorted((r.line, r.alert or "") for r in batch)


def test_counter_delta(spark, stream, run):
    rows = [("s", n, n, t, x) for n, (t, x) in enumerate([(1000, 1000), (1000, 9), (1500, 500), (1000, 100), (None, 50), (None, 9), (1200, None)])]
    df = spark.createDataFrame(rows, "sid string, line long, ts_s long, total long, last long")
    got = run(jobs.counter_delta_stream(stream(df, 1)))
    shaped = df.select("sid", "line", F.when(F.col("total").isNotNull(), F.struct(F.col("total").alias("input"))).alias("total"), F.when(F.col("last").isNotNull(), F.struct(F.col("last").alias("input"))).alias("last"))
    batch = counters.counter_delta(shaped, ["input"]).collect()
    assert sorted((r.line, r.delta, r.diagnostic or "") for r in got) == sorted((r.line, r.delta_input, r.diagnostic or "") for r in batch)


def test_stale_samples(spark, stream, run):
    df = spark.createDataFrame([("w", n, n, float(u)) for n, u in enumerate([5, 9, 9, 4, 12])], "window string, line long, ts_s long, used_percent double")
    got = run(jobs.stale_sample_filter(stream(df, 1)))
    assert sorted(r.line for r in got) == sorted(r.line for r in windows.rising_only(df, ["window"]).collect()) == [0, 1, 4]


def test_context_arm(spark, stream, run):
    df = spark.createDataFrame([("s", n, n, c, 100) for n, c in enumerate([50, 96, 97, 60, 99, 40, 96, 30, 98, 10, 99])], "sid string, line long, ts_s long, context long, threshold long")
    assert sorted((r.line, r.n) for r in run(jobs.context_arm_stream(stream(df, 1)))) == [(1, 1), (6, 2), (8, 3)]


def test_idle_guard(spark, stream, run):
    kinds = [(0, "reply"), (100, "prompt"), (200, "reply"), (9000, "reply"), (90000, "prompt"), (90001, "prompt")]
    df = spark.createDataFrame([("s" if t < 90000 else "z", t, t, k) for t, k in kinds], "sid string, line long, ts_s long, kind string")
    df = stream(df).withColumn("ts", F.timestamp_seconds("ts_s")).withWatermark("ts", "1 seconds")
    assert sorted((r.line, r.idle_at) for r in run(jobs.idle_guard_stream(df)))[-1] == (9000, 12590)


def test_running_turn_cost(spark, stream, run):
    times = [0, 30, 90, 151, 300, 300, 500, 560, 700]
    df = spark.createDataFrame([(s, n, t, 10 + n) for s in ("s", "z") for n, t in enumerate(times)], "sid string, line long, ts_s long, cost_e8 long")
    got = run(jobs.running_turn_cost_stream(stream(df)))
    batch = limits.idle_turn_cost(df).collect()
    assert sorted((r.sid, r.line, r.turn, r.turn_cost_e8) for r in got) == sorted((r.sid, r.line, r.turn, r.turn_cost_e8) for r in batch)


def test_requests_go_to_the_session_that_starts_first(spark, tmp_path, run):
    """As A4 in batch, with copies in other micro-batches, before and after their owner's."""
    rows, base = [], 10**6
    for n in range(60):
        rows.append((f"s{n % 4}", f"r{n}", base + 60 * n + 7 * (n % 4), n))
        if n % 3 == 0:  # copies under other sessions, some of which start earlier
            rows.append((f"s{(n + 1) % 4}", f"r{n}", base + 60 * n + 400, 100 + n))
            rows.append(("a late one", f"r{n}", base + 60 * n + 900, 200 + n))
    rows += [("s0", None, base + 50, 1000), ("s1", "", base + 60, 1001)]
    schema = "sid string, req string, ts_s long, line long"
    ordered, source = sorted(rows, key=lambda r: r[2]), str(tmp_path / "in")
    files = [ordered[k : k + 25] for k in range(0, len(ordered), 25)] + [[("end", f"end{k}", k * 10**7, 0)] for k in (1, 2, 3)]
    files[1], files[2] = files[1] + files[2][:5], files[2][5:]
    files[0], files[1] = files[0][:-3], files[0][-3:] + files[1]  # some are late
    for some in files:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_seconds("ts_s"))
    got = run(jobs.request_once_stream(live, "20 minutes", 3600))
    batch = ledger.count_request_once(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r.req or "", r.sid, r.line)
    assert sorted(map(key, (r for r in got if r.sid != "end"))) == sorted(map(key, batch))


def test_request_once_and_hours(spark, stream, tmp_path):
    df = spark.createDataFrame([(f"r{n % 4}", 600 * n, n, 1) for n in range(20)], "req string, ts_s long, cost_e8 long, tokens long")
    live = stream(df).withColumn("ts", F.timestamp_seconds("ts_s"))
    once = jobs.run_to_end(jobs.first_copy_stream(live, "10 days"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted(r.req for r in once.collect()) == ["r0", "r1", "r2", "r3"]
    hours = jobs.run_to_end(jobs.hourly_usage_stream(live, "10 minutes"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    want = {}
    for n in range(20):
        want[600 * n // 3600] = want.get(600 * n // 3600, 0) + n
    got = {int(r.s) // 3600: r.cost_e8 for r in hours.select(F.unix_timestamp("w.start").alias("s"), "cost_e8").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    cost = jobs.run_to_end(jobs.turn_cost_stream(live.withColumn("sid", F.lit("s")), late="1 minutes"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert cost.count() > 0
