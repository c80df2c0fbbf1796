"""The line source, batch and stream, and the tables that follow it."""

import json
import os
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from meterwright.sources import lines, refresh, transcripts
from meterwright.streaming import jobs


def plain(path):
    data = path.read_bytes()
    parts = data.split(b"\n")
    if parts and not parts[-1]:
        parts.pop()
    return [(k + 1, t) for k, t in enumerate(p.removesuffix(b"\r").decode("utf-8", "replace") for p in parts) if t]


@pytest.fixture
def files(tmp_path):
    rng = random.Random(3)
    made = {
        "empty": b"", "no end": b"a\nb", "crlf": b"a\r\n\r\nb\r\n", "blank": b"\n\n\nx\n\n", "bytes": b"\xff\xfe\n\xc3\xa9\n",
        "long": b"x" * 5000 + b"\n" + b"y" * 3000 + b"\nz",
        "many": b"".join(bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) + rng.choice([b"\n", b"\r\n"]) for _ in range(700)),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.jsonl").write_bytes(data)
    (tmp_path / "other.txt").write_text("not asked for\n")
    return tmp_path


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_ranges_hold_every_line_once(files, monkeypatch, split, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    for path in files.glob("*.jsonl"):
        if split == 1 and path.stat().st_size > 1000:
            continue
        size, data, got = path.stat().st_size, path.read_bytes(), []
        for a in range(0, size, split):
            number = data[:a].count(b"\n")
            for place, line in lines._lines(str(path), a, min(a + split, size)):
                number += 1
                if place >= 0:
                    assert data[place : place + len(line)] == line
                    got.append((number, lines._text(line)))
        assert [x for x in got if x[1]] == plain(path), (path.name, split)


def test_one_scan_numbers_lines_over_splits(spark, files):
    want = sorted((f"file://{p}", n, t) for p in files.glob("*.jsonl") for n, t in plain(p))
    for split in (100, 1 << 20):
        df = transcripts.scan_transcripts(spark, [f"file://{files}/*.jsonl"], split=split)
        assert sorted((r.path, r.line_no, r.raw) for r in df.collect()) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"BatchScan", plan)) == 1 and not re.search("Join|Exchange", plan)
    parts = transcripts.scan_transcripts(spark, [f"{files}/many.jsonl"], split=100).rdd.getNumPartitions()
    assert parts == -(-(files / "many.jsonl").stat().st_size // 100)
    row = transcripts.scan_transcripts(spark, [f"{files}/crlf.jsonl"]).first()
    assert row.size == 8 and row.mtime.timestamp() == pytest.approx(os.stat(files / "crlf.jsonl").st_mtime, abs=1)


def test_listing(files):
    (files / "deep").mkdir()
    (files / "deep" / "a.jsonl").write_text("x\n")
    (files / "deep" / "_hidden.jsonl").write_text("x\n")
    names = lambda *p: [f.path.rsplit("/", 1)[1] for f in lines.list_files([f"{files}/{x}" for x in p])]
    assert names("*/*.jsonl") == ["a.jsonl"] and names("deep", "d*/a.jsonl") == ["a.jsonl"]
    assert len(names("*.jsonl")) == 7 and names("none/*.jsonl") == [] and names("many.jsonl") == ["many.jsonl"]


def test_a_file_that_grows_after_it_was_counted(files):
    path = files / "many.jsonl"
    f = lines.list_files([str(path)])[0]
    index = {f.path: [path.read_bytes()[:a].count(b"\n") for a in range(0, f.size, 500)]}
    with path.open("ab") as out:
        out.write(b"more\n" * 300)
    parts = lines.planned(lines.list_files([str(path)]), 500, index)
    got = []
    for p in parts:
        (r,) = p.ranges
        number = r.before
        for place, line in lines._lines(r.file.path, r.start, r.end):
            number += 1
            if place >= 0 and lines._text(line):
                got.append((number, lines._text(line)))
    assert got == plain(path)


def test_malformed_lines_are_counted_in_the_same_pass(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"b": 2\n{"c": 3}\n')
    counts = Observation("parse")
    df = transcripts.parse_tolerant(transcripts.scan_transcripts(spark, [f"{tmp_path}/*.jsonl"]), counts)
    assert sorted(r.line_no for r in df.collect()) == [1, 5]
    assert counts.get == {"lines": 4, "malformed": 2}


def test_limit_log_keeps_its_lines_and_counts_rejects(spark, tmp_path):
    head = "ts,pct_5h,reset_5h,pct_7d,reset_7d,alert,version"
    (tmp_path / "s1.csv").write_text(f"{head}\n2026-01-01T00:00:00Z,10,500,1,900,,v1\nbroken\n\n2026-01-01T00:01:00Z,20,,2,,warn,v1\n2026-01-01T00:02:00Z,x,,2,,,v1\n")
    counts = Observation("log")
    got = sorted(transcripts.read_ratelimit_log(spark, [f"{tmp_path}/*.csv"], counts).collect(), key=lambda r: r.line)
    assert [(r.sid, r.line, r.pct_5h, r.reset_5h, r.reset_7d, r.alert) for r in got] == [("s1", 2, 10.0, 500, 900, None), ("s1", 5, 20.0, 500, 900, "warn")]
    assert counts.get == {"lines": 4, "malformed": 2}


# --- refresh


def words(df):
    return df.select("path", "line_no", F.explode(F.split("raw", " ")).alias("word")).where("word <> 'skip'")


def state(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("part=*/*.parquet")}


def test_refresh_derives_changed_files_only(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    for k in range(12):
        (source / f"f{k}.jsonl").write_text(f"a{k} b\nc{k}\n")
    refreshed = lambda version=1: refresh.incremental_refresh(spark, [f"{source}/*.jsonl"], str(table), words, version, parts=7)
    content = lambda: sorted((r.path.rsplit("/", 1)[1], r.line_no, r.word) for r in refresh.read_refreshed(spark, str(table)).collect())
    fresh = lambda: sorted((r.path.rsplit("/", 1)[1], r.line_no, r.word) for r in words(transcripts.scan_transcripts(spark, [f"{source}/*.jsonl"])).collect())
    assert refreshed().derived == 12 and content() == fresh()
    before = state(table)
    assert refreshed() == (0, 12, []) and state(table) == before
    (source / "f3.jsonl").write_text("changed now\n")
    (source / "new.jsonl").write_text("n\n")
    done = refreshed()
    assert (done.derived, done.unchanged) == (2, 11) and content() == fresh()
    after = state(table)
    same = {k for k, v in before.items() if after.get(k) == v}
    part = lambda k: int(re.search(r"part=(\d+)", k)[1])
    assert same == {k for k in before if part(k) not in done.parts} != set()
    # a file that is gone keeps its rows; one without rows leaves none
    gone = [r for r in content() if r[0] == "f5.jsonl"]
    (source / "f5.jsonl").unlink()
    for k in range(12):
        if k not in (3, 5):
            (source / f"f{k}.jsonl").write_text("skip\n")
    assert refreshed().derived == 10 and content() == sorted(fresh() + gone)
    assert refreshed(2).derived == 12 and content() == sorted(fresh() + gone)


def test_refresh_that_was_stopped_before_its_manifest(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    (source / "a.jsonl").write_text("x y\n")
    run = lambda derive: refresh.incremental_refresh(spark, [f"{source}/*.jsonl"], str(table), derive, 1, parts=2)

    def broken(df):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        run(broken)
    assert run(words).derived == 1
    (source / "a.jsonl").write_text("z z z\n")
    with pytest.raises(Exception):
        run(lambda df: words(df).withColumn("word", F.raise_error(F.lit("stopped"))))
    assert [r.word for r in refresh.read_refreshed(spark, str(table)).collect()] == ["x", "y"]
    assert run(words).derived == 1
    assert [r.word for r in refresh.read_refreshed(spark, str(table)).collect()] == ["z"] * 3


# --- the stream of appended lines


def test_appended_lines_come_once(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    a, b = source / "a.jsonl", source / "b.jsonl"
    run = lambda: jobs.ledger_append_stream(spark, [f"{source}/*.jsonl"], out, check, split=50)
    got = lambda: sorted((r.path.rsplit("/", 1)[1], r.line_no, r.raw) for r in jobs.appended_lines(spark, out).collect())
    want = lambda: sorted((p.name, n, t) for p in source.glob("*.jsonl") for n, t in plain(p))
    a.write_text("".join(f"line {k}\n" for k in range(30)) + "half")
    run()
    assert got() == [x for x in want() if x[2] != "half"]
    with a.open("a") as f:
        f.write(" done\n\nafter a blank\r\n")
    b.write_text("new\n")
    run()
    assert got() == want()
    run()  # nothing new
    assert got() == want()
    with b.open("a") as f:
        f.write("x\ny\n")
    run()
    assert got() == want() and len(got()) == 30 + 2 + 3


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    """Stopped after the lines were written and before the batch was committed."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"
    source.mkdir()
    run = lambda: jobs.ledger_append_stream(spark, [f"{source}/*.jsonl"], out, str(check))
    (source / "a.jsonl").write_text("1\n2\n")
    run()
    with (source / "a.jsonl").open("a") as f:
        f.write("3\n4\n")
    run()
    last = max(int(p.name) for p in (check / "commits").iterdir() if p.name.isdigit())
    for p in [check / "commits" / str(last), check / "commits" / f".{last}.crc"]:
        p.unlink(missing_ok=True)
    with (source / "a.jsonl").open("a") as f:
        f.write("5\n")
    run()
    run()
    assert sorted((r.line_no, r.raw) for r in jobs.appended_lines(spark, out).collect()) == [(k, str(k)) for k in range(1, 6)]


def test_rows_of_appended_lines_feed_the_ledger(spark, tmp_path):
    source, out = tmp_path / "p", str(tmp_path / "out")
    source.mkdir()
    call = {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "requestId": "r1", "message": {"model": "m", "usage": {"input_tokens": 5, "output_tokens": 2}}}
    (source / "s1.jsonl").write_text(json.dumps({"type": "user"}) + "\n" + json.dumps(call) + "\n")
    jobs.ledger_append_stream(spark, [f"{source}/*.jsonl"], out, str(tmp_path / "check"))
    rows = transcripts.usage_rows(transcripts.parse_tolerant(jobs.appended_lines(spark, out))).collect()
    assert [(r.line, r.req, r.input, r.out) for r in rows] == [(2, "r1", 5, 2)]
