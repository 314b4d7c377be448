"""Sinks, streams, upkeep and whole runs."""

import csv
import datetime as dt
import glob
import gzip
import json
import os
import runpy
import shutil
import time

import pyarrow.parquet
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

import dwelltrace
from dwelltrace.functions.durations import duration_to_millis
from dwelltrace.operators import rules as R
from dwelltrace.plans.etl import run_pipeline, write_outputs
from dwelltrace.plans.workspace import shared_folder
from dwelltrace.schemas import SAMPLE_SCHEMA, WINDOW_DATA_SCHEMA
from dwelltrace.sinks.lines import event_lines, utc_text, write_lines

MADE = [R.Rule(R.HasTag("term"), (R.AddTag("made"),))]


@pytest.fixture
def two_logs(fixture_path):
    return [fixture_path("logs", "paths.jsonl"), fixture_path("logs", "phones.jsonl")]


def files(folder, suffix):
    return sorted(p for p in glob.glob(f"{folder}/**/*", recursive=True) if p.endswith(suffix))


def text_of(folder, suffix):
    return "".join(open(p, encoding="utf-8", newline="").read() for p in files(folder, suffix))


def multiset(df):
    return sorted(repr(tuple(r)) for r in df.collect())


# -- tables ------------------------------------------------------------------------------


def test_csv_is_flat(spark, two_logs, tmp_path):
    outputs = write_outputs(
        dwelltrace.active_events(spark, two_logs, MADE).coalesce(1), dwelltrace.unlock_events(spark, two_logs), str(tmp_path), "csv"
    )
    assert outputs.active_events == f"{tmp_path}/active_events.csv"
    (path,) = files(outputs.active_events, ".csv")
    text = open(path).read()
    assert text.startswith("time,duration,hostname,")
    assert "[" not in text and "]" not in text
    rows = sorted(csv.DictReader(open(path)), key=lambda r: r["time"])
    assert [r["tags"] for r in rows] == ["", "", "", "", "term|root|made", "odd", "", "term|made", "", ""]
    assert [r["duration"] for r in rows] == ["600", "130", "5", "30", "30", "0", "30", "30", "30", "30"]
    assert [r["idleFor"] for r in rows] == ["", "", "", "0", "61", "3599", "1", "2", "60", "600"]
    assert rows[1]["time"] == "2040-11-05T07:10:00.500000"
    assert rows[7]["processPath"] == "\\\\share\\x/y\\Mixed.tar.EXE"
    # An empty list is an empty string, which CSV tells apart from null by its quotes.
    assert any(line.endswith(',false,false,""') for line in text.splitlines())
    unlocks = [row for p in files(outputs.unlock_events, ".csv") for row in csv.DictReader(open(p))]
    assert {"time": "2040-11-05T07:09:59.000000", "hostname": "fold"} in unlocks and len(unlocks) == 3


def test_csv_keeps_awkward_text(spark, tmp_path):
    values = [' padded "quoted" ', "comma,", "back\\slash\\", "line\nbreak", "é"]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    dwelltrace.write_table(df, str(tmp_path / "t"), "csv")
    (path,) = files(tmp_path, ".csv")
    assert [r["v"] for r in csv.DictReader(open(path, newline=""))] == values


def test_flatten_goes_by_type(spark):
    df = spark.sql("SELECT array(1, null, 2) AS a, INTERVAL '0 00:00:01.9' DAY TO SECOND AS d, INTERVAL '-0 00:00:01.9' DAY TO SECOND AS n, 'x' AS s")
    assert tuple(dwelltrace.flatten(df).first()) == ("1|2", 1, -1, "x")


def test_parquet_keeps_types_and_replaces(spark, two_logs, tmp_path):
    df = dwelltrace.active_events(spark, two_logs)
    target = str(tmp_path / "deep" / "er" / "t.parquet")
    dwelltrace.write_table(df, target, "parquet")
    dwelltrace.write_table(df, target, "parquet")
    back = spark.read.parquet(target)
    assert [(f.name, f.dataType) for f in back.schema.fields] == [(f.name, f.dataType) for f in df.schema.fields]
    assert multiset(back) == multiset(df)


def test_files_are_bounded_on_request(spark, tmp_path):
    dwelltrace.write_table(spark.range(100).coalesce(1), str(tmp_path / "t"), "parquet", max_records_per_file=30)
    sizes = [pyarrow.parquet.read_metadata(p).num_rows for p in files(tmp_path, ".parquet")]
    assert sorted(sizes) == [10, 30, 30, 30]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="xml"):
        dwelltrace.write_table(spark.range(1), str(tmp_path / "t"), "xml")


# -- event logs --------------------------------------------------------------------------


def test_lines_are_written_byte_for_byte(spark, tmp_path):
    lines = ['{"a":"x,y \\"q\\" \\\\"}', "  leading and trailing  ", "#comment", "torn {\"", "tab\there", "é😀", "''", '""', '"']
    write_lines(spark.createDataFrame([(x,) for x in [*lines, "", "   "]], "v string").coalesce(1), str(tmp_path / "l"))
    assert text_of(tmp_path, ".jsonl") == "".join(x + "\n" for x in lines)


@pytest.mark.parametrize(
    "time, text",
    [
        (dt.datetime(1970, 1, 1), "1970-01-01T00:00:00Z"),
        (dt.datetime(2026, 3, 8, 2, 30, 0, 500000), "2026-03-08T02:30:00.500Z"),
        (dt.datetime(2026, 1, 2, 3, 4, 5, 120300), "2026-01-02T03:04:05.120300Z"),
    ],
)
def test_utc_text(spark, time, text):
    df = spark.createDataFrame([(time,)], "t timestamp_ntz")
    assert df.select(utc_text(F.col("t"))).first()[0] == text


def live_rules(fixture_path):
    return dwelltrace.load_recorder_config(fixture_path("live", "recorder_config.json")).rules


def test_live_events_golden(spark, fixture_path):
    events = dwelltrace.read_runtime_events(spark, fixture_path("live", "runtime_input.jsonl"))
    expected = dwelltrace.read_runtime_events(spark, fixture_path("live", "runtime_expected.jsonl"))
    out = dwelltrace.transform_live_events(events, live_rules(fixture_path))
    assert out.count() == 5
    assert multiset(out) == multiset(expected)


def test_logged_lines_golden(spark, fixture_path):
    events = dwelltrace.read_runtime_events(spark, fixture_path("live", "runtime_input.jsonl"))
    lines = event_lines(dwelltrace.record(events, live_rules(fixture_path)))
    expected = open(fixture_path("live", "logged_expected.jsonl")).read().splitlines()
    assert sorted(r.value for r in lines.collect()) == sorted(expected)


def test_title_never_reaches_the_log(spark, fixture_path, tmp_path):
    stream = dwelltrace.stream_runtime_events(spark, _feed(fixture_path, tmp_path))
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    dwelltrace.start_recorder(stream, live_rules(fixture_path), folder, checkpoint=state).awaitTermination()
    everything = "".join(
        open(p, "rb").read().decode("utf-8", "replace") for root in (folder, state) for p in files(root, "") if os.path.isfile(p)
    )
    assert "krita" in everything
    assert "Draft" not in everything and "windowTitle" not in everything


# -- samples -----------------------------------------------------------------------------


def test_samples(spark):
    now = dt.datetime(2026, 1, 1, 12)
    rows = [
        (now, "h", "u", True, True, "locked", "/a", 1.0),
        (now, "h", "u", False, False, None, None, 1.0),
        (now, "h", "u", False, True, "Task Manager", None, 4.5),
        (now, "h", "u", False, True, "Some Window", "/usr/bin/firefox", 5.4),
        (now, "h", "u", False, True, None, "/x", 0.0),
    ]
    df = spark.createDataFrame(rows, SAMPLE_SCHEMA)
    out = dwelltrace.samples_to_events(df, 14.6)
    assert out.schema["data"].dataType == WINDOW_DATA_SCHEMA
    got = {(r.windowTitle, r.data.processPath, r.data.idleFor, r.data.duration, tuple(r.data.tags)) for r in out.collect()}
    assert got == {
        ("Task Manager", None, 5.0, 15.0, ()), ("Some Window", "/usr/bin/firefox", 5.0, 15.0, ()), ("", "/x", 0.0, 15.0, ()),
    }


# -- streams -----------------------------------------------------------------------------


def _feed(fixture_path, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir(exist_ok=True)
    shutil.copy(fixture_path("live", "runtime_input.jsonl"), feed / "a.jsonl")
    return str(feed)


def test_recorder_stream_goes_on_after_a_restart(spark, fixture_path, tmp_path):
    feed, folder, state = _feed(fixture_path, tmp_path), str(tmp_path / "log"), str(tmp_path / "state")
    rules = live_rules(fixture_path)

    def run():
        dwelltrace.start_recorder(dwelltrace.stream_runtime_events(spark, feed), rules, folder, checkpoint=state).awaitTermination()
        return dwelltrace.read_log_root(spark, folder).count()

    assert run() == 5
    assert run() == 5
    shutil.copy(fixture_path("live", "runtime_input.jsonl"), f"{feed}/b.jsonl")
    assert run() == 10
    assert all(p.endswith(".jsonl") for p in files(folder, "") if os.path.isfile(p) and "/part-" in p)


def test_a_replayed_batch_replaces_itself_and_a_new_query_does_not(spark, fixture_path, tmp_path):
    feed, folder = _feed(fixture_path, tmp_path), str(tmp_path / "log")
    rules = live_rules(fixture_path)

    def run(state):
        stream = dwelltrace.stream_runtime_events(spark, feed)
        dwelltrace.start_recorder(stream, rules, folder, checkpoint=state).awaitTermination()
        return dwelltrace.read_log_root(spark, folder).count()

    state = str(tmp_path / "state")
    assert run(state) == 5
    # A crash between the write and its confirmation: the batch is not marked as done.
    for name in ("0", ".0.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    assert run(state) == 5
    assert run(str(tmp_path / "other-state")) == 10


def test_no_events_no_file(spark, fixture_path, tmp_path):
    delete_all = [R.Rule(R.And(()), (R.Delete(),))]
    stream = dwelltrace.stream_runtime_events(spark, _feed(fixture_path, tmp_path))
    folder = str(tmp_path / "log")
    dwelltrace.start_recorder(stream, delete_all, folder, checkpoint=str(tmp_path / "state")).awaitTermination()
    assert files(folder, ".jsonl") == []


def test_periodic_flush_and_stop(spark, fixture_path, tmp_path):
    feed, folder, state = _feed(fixture_path, tmp_path), str(tmp_path / "log"), str(tmp_path / "state")

    def record(every_sec=None):
        stream = dwelltrace.stream_runtime_events(spark, feed)
        return dwelltrace.start_recorder(stream, live_rules(fixture_path), folder, checkpoint=state, every_sec=every_sec)

    query = record(every_sec=3600)
    deadline = time.monotonic() + 60
    while not files(folder, ".jsonl") and time.monotonic() < deadline:
        time.sleep(0.2)
    shutil.copy(fixture_path("live", "runtime_input.jsonl"), f"{feed}/b.jsonl")
    dwelltrace.flush_and_stop(query, record)
    assert not query.isActive
    assert dwelltrace.read_log_root(spark, folder).count() == 10


def test_live_tables_equal_the_batch(spark, fixture_path, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    names = ["paths", "flat_keys", "phones", "household"]
    state, outputs = str(tmp_path / "state"), (str(tmp_path / "a"), str(tmp_path / "u"))
    for half in (names[:2], names[2:]):
        for name in half:
            shutil.copy(fixture_path("logs", f"{name}.jsonl"), logs)
        dwelltrace.start_live_tables(spark, str(logs), MADE, *outputs, checkpoint=state, max_files_per_trigger=1).awaitTermination()
    paths = [fixture_path("logs", f"{name}.jsonl") for name in names]
    read = spark.read.option("recursiveFileLookup", True)
    assert multiset(read.parquet(outputs[0])) == multiset(dwelltrace.active_events(spark, paths, MADE))
    assert multiset(read.parquet(outputs[1])) == multiset(dwelltrace.unlock_events(spark, paths))


def test_a_stream_refuses_a_torn_line_or_drops_it(spark, write_log, tmp_path):
    root = os.path.dirname(write_log('{"type":"DeviceUnlockEventV1","time":"2026-01-01T00:00:00Z"}', '{"type', name="in/x.jsonl"))
    a, u = str(tmp_path / "a"), str(tmp_path / "u")
    with pytest.raises(PySparkException):
        dwelltrace.start_live_tables(spark, root, [], a, u, checkpoint=str(tmp_path / "s1")).awaitTermination()
    dwelltrace.start_live_tables(spark, root, [], a, u, checkpoint=str(tmp_path / "s2"), on_corrupt="drop").awaitTermination()
    assert spark.read.option("recursiveFileLookup", True).parquet(u).count() == 1


# -- upkeep ------------------------------------------------------------------------------


def _root(fixture_path, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    for name in ("paths", "flat_keys", "phones", "household"):
        shutil.copy(fixture_path("logs", f"{name}.jsonl"), root / "sub")
    with gzip.open(root / "more.jsonl.gz", "wt") as f:
        f.write('{"type":"NewEventV7","x":[1, 2]}\n\n{"torn\n{"type":"ActiveWindowEvent","duration":"bad"}\n')
    return root


def _raw_lines(root):
    plain = [line for p in files(root, ".jsonl") for line in open(p, encoding="utf-8")]
    packed = [line for p in files(root, ".jsonl.gz") for line in gzip.open(p, "rt", encoding="utf-8")]
    return sorted(line.rstrip("\n") for line in plain + packed if line.strip())


def test_compaction_keeps_every_line(spark, fixture_path, tmp_path):
    root, target = _root(fixture_path, tmp_path), tmp_path / "compacted"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    dwelltrace.compact_logs(spark, str(root), str(target))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert _raw_lines(target) == _raw_lines(root)
    assert len(files(target, ".jsonl.gz")) < 5 and not files(target, ".jsonl")


def test_compaction_with_upgrade(spark, fixture_path, tmp_path):
    root, target = _root(fixture_path, tmp_path), tmp_path / "compacted"
    dwelltrace.compact_logs(spark, str(root), str(target), upgrade=True)
    lines = _raw_lines(target)
    legacy = [line for line in lines if '"ActiveWindowEvent"' in line]
    assert legacy == ['{"type":"ActiveWindowEvent","duration":"bad"}']
    assert set(_raw_lines(root)) - set(lines) == {x for x in _raw_lines(root) if '"ActiveWindowEvent"' in x} - set(legacy)
    game = json.loads(next(line for line in lines if "games" in line))
    assert game == {
        "type": "ActiveWindowEventV1", "time": "2040-11-05T12:00:00Z",
        "data": {
            "duration": 9, "hostname": "barn", "username": "lee", "idleFor": 0.2, "processPath": "/usr/games/Chess",
            "tags": ["fun", "board"],
        },
    }


@pytest.mark.parametrize("target", ["", "/inner", "/.."])
def test_compaction_into_its_source_is_refused(spark, tmp_path, target):
    with pytest.raises(ValueError):
        dwelltrace.compact_logs(spark, str(tmp_path), os.path.normpath(f"{tmp_path}{target}"))


def test_upgrade_gives_the_same_table(spark, fixture_path):
    paths = [fixture_path("logs", f"{n}.jsonl") for n in ("flat_keys", "household", "phones")]
    logs = dwelltrace.read_logs(spark, paths)
    upgraded = dwelltrace.upgrade_legacy(logs)
    assert upgraded.schema == logs.schema or upgraded.columns == logs.columns
    assert upgraded.filter("type = 'ActiveWindowEvent' or duration is not null").count() == 0
    assert multiset(dwelltrace.active_events_from(upgraded)) == multiset(dwelltrace.active_events_from(logs))
    assert multiset(dwelltrace.unlock_events_from(upgraded)) == multiset(dwelltrace.unlock_events_from(logs))


def _split(spark, fixture_path, seconds, **options):
    df = dwelltrace.split_long_events(dwelltrace.active_events(spark, fixture_path("logs", "phones.jsonl")), seconds, **options)
    rows = df.select("time", duration_to_millis(F.col("duration"))).orderBy("time").collect()
    return [((r[0] - dt.datetime(2040, 11, 5, 7)).total_seconds(), r[1] / 1000) for r in rows]


def test_split_long_events(spark, fixture_path):
    whole, rest = [(0, 600)], [(1800, 5)]
    assert _split(spark, fixture_path, 250) == [(0, 250), (250, 250), (500, 100), (600.5, 130.25), *rest]
    ends = [(-350, 250), (-100, 250), (0, 100), (600.5, 130.25), *rest]
    assert _split(spark, fixture_path, 250, anchor="end") == ends
    assert _split(spark, fixture_path, 100)[6:] == [(600.5, 100), (700.5, 30.25), *rest]
    assert _split(spark, fixture_path, 600) == _split(spark, fixture_path, 0) == [*whole, (600.5, 130.25), *rest]
    assert len(_split(spark, fixture_path, 1)) == 600 + 131 + 5


def test_split_leaves_other_rows_alone(spark, write_log):
    desktop = '{"type":"ActiveWindowEventV1","time":"2026-01-01T00:00:00Z","data":{"duration":500}}'
    phone = '{"type":"ActiveActivityEventV1","time":"2026-01-01T00:00:00Z","data":{"duration":%s}}'
    df = dwelltrace.active_events(spark, write_log(desktop, phone % "0", phone % "null", phone % "-500"))
    assert multiset(dwelltrace.split_long_events(df, 60)) == multiset(df)


def test_split_of_a_very_long_event(spark, write_log):
    line = '{"type":"ActiveActivityEventV1","time":"2026-01-01T00:00:00Z","data":{"duration":1000000.25}}'
    pieces = dwelltrace.split_long_events(dwelltrace.active_events(spark, write_log(line)), 1)
    n, total, first, last = pieces.select(
        F.count("*"), F.sum(duration_to_millis(F.col("duration"))), F.min("time"), F.max("time")
    ).first()
    assert (n, total) == (1000001, 1000000250)
    assert last - first == dt.timedelta(seconds=1000000)


# -- whole runs --------------------------------------------------------------------------


def _config(tmp_path, **changes):
    content = {
        "logDirectory": "root", "logOutputSubdirectory": ".", "sampleEverySec": 15, "writeEverySec": 3600,
        "pipelineConfigPath": "rules.json", "pipelineOutputDirectory": "out", "pipelineOutputFormat": "parquet",
    }
    rules = {
        "activeEventRules": [
            {"predicate": {"idleForGreaterThanSec": 60}, "actions": ["ignore"]},
            {"predicate": "isMobile", "actions": [{"addTag": "mobile"}]},
            {"predicate": {"hasTag": "term"}, "actions": [{"setAttribute": {"name": "category", "value": "shell"}}]},
        ],
        "activeEventMaxDuration": 60,
    }
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    path = tmp_path / "main.json"
    path.write_text(json.dumps(content | changes))
    return str(path)


def _two_file_root(fixture_path, tmp_path):
    (tmp_path / "root").mkdir(exist_ok=True)
    for name in ("paths", "phones"):
        shutil.copy(fixture_path("logs", f"{name}.jsonl"), tmp_path / "root")


@pytest.mark.parametrize("scan", ["staged", "direct"])
def test_run(spark, fixture_path, tmp_path, scan):
    _two_file_root(fixture_path, tmp_path)
    outputs = run_pipeline(spark, _config(tmp_path), scan=scan)
    assert outputs.active_events == f"{tmp_path}/out/active_events.parquet"
    rows = spark.read.parquet(outputs.active_events).orderBy("time").collect()
    assert [r.ignore for r in rows] == [False] * 4 + [True, True, False, False, False, True]
    assert [r.tags for r in rows] == [["mobile"]] * 3 + [[], ["term", "root"], ["odd"], [], ["term"], [], []]
    assert [r.category for r in rows] == [None] * 4 + ["shell", None, None, "shell", None, None]
    assert {r.hostname for r in spark.read.parquet(outputs.unlock_events).collect()} == {"fold", None}


def test_run_options(spark, fixture_path, tmp_path):
    _two_file_root(fixture_path, tmp_path)
    outputs = run_pipeline(spark, _config(tmp_path), drop_ignored=True, split_long=True, partition_bytes=1 << 20)
    assert spark.read.parquet(outputs.active_events).count() == 10 - 3 + 9 + 2


def test_run_leaves_no_staged_rows(spark, fixture_path, tmp_path):
    _two_file_root(fixture_path, tmp_path)
    run_pipeline(spark, _config(tmp_path), scan="staged")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert glob.glob(f"{shared}/dwelltrace/logs-*") == []


@pytest.mark.parametrize("policy", ["file", "line"])
@pytest.mark.parametrize("scan", ["direct", "staged"])
def test_a_refused_run_keeps_the_previous_output(spark, fixture_path, tmp_path, scan, policy):
    _two_file_root(fixture_path, tmp_path)
    outputs = run_pipeline(spark, _config(tmp_path))
    before = [multiset(spark.read.parquet(path)) for path in (outputs.active_events, outputs.unlock_events)]
    shutil.copy(fixture_path("logs", "household.jsonl"), tmp_path / "root")  # a good file more
    shutil.copy(fixture_path("live", "main_config.json"), tmp_path / "root" / "foreign.jsonl")
    with pytest.raises(dwelltrace.JobError):
        run_pipeline(spark, _config(tmp_path), on_corrupt=policy, scan=scan)
    assert before == [multiset(spark.read.parquet(path)) for path in (outputs.active_events, outputs.unlock_events)]
    assert sorted(os.listdir(tmp_path / "out")) == ["active_events.parquet", "unlock_events.parquet"]
    run_pipeline(spark, _config(tmp_path), on_corrupt="drop", scan=scan)
    assert spark.read.parquet(outputs.active_events).count() == 13


@pytest.mark.parametrize("scan", ["direct", "staged"])
def test_a_torn_line_does_not_stop_a_run(spark, fixture_path, tmp_path, scan):
    _two_file_root(fixture_path, tmp_path)
    with open(tmp_path / "root" / "phones.jsonl", "a") as log:
        log.write('{"type":"Device')
    outputs = run_pipeline(spark, _config(tmp_path), scan=scan)
    assert spark.read.parquet(outputs.active_events).count() == 10


def test_run_errors_have_context(spark, tmp_path):
    with pytest.raises(dwelltrace.JobError, match="missing.json"):
        run_pipeline(spark, str(tmp_path / "missing.json"))
    with pytest.raises(dwelltrace.JobError, match="root"):
        run_pipeline(spark, _config(tmp_path))
    with pytest.raises(ValueError):
        run_pipeline(spark, _config(tmp_path), scan="sideways")


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_command_line(spark, fixture_path, tmp_path, monkeypatch, capsys):
    _two_file_root(fixture_path, tmp_path)
    monkeypatch.setattr("sys.argv", ["dwelltrace", _config(tmp_path), "--drop-ignored", "--split-long"])
    runpy.run_module("dwelltrace", run_name="__main__")
    active, unlock = capsys.readouterr().out.split()
    assert spark.read.parquet(active).count() == 10 - 3 + 9 + 2
    assert spark.read.parquet(unlock).count() == 3


# -- what a run costs --------------------------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_type_filter_reaches_the_reader_below_an_observation(spark, fixture_path, tmp_path):
    _two_file_root(fixture_path, tmp_path)
    logs = dwelltrace.read_log_root(
        spark, str(tmp_path / "root"), types=["DeviceUnlockEventV1"], on_corrupt="drop", dropped=Observation()
    )
    assert "PushedFilters: [Or(IsNull(type)," in _plan(dwelltrace.unlock_events_from(logs))


def test_filters_do_not_copy_rule_expressions(spark, fixture_path):
    path = fixture_path("logs", "paths.jsonl")
    rules = [R.Rule(R.AttributeRegex("name", f"[abc]{k}+"), (R.SetAttribute("category", "x"), R.Ignore())) for k in range(5)]
    plain = dwelltrace.active_events(spark, path, rules)
    optimized = [df._jdf.queryExecution().optimizedPlan().toString() for df in (plain, dwelltrace.drop_ignored(plain))]
    assert optimized[0].count("RLIKE") == optimized[1].count("RLIKE")
    events = dwelltrace.read_runtime_events(spark, fixture_path("live", "runtime_input.jsonl"))
    gone = [R.Rule(R.AttributeValue("processName", "konsole"), (R.Delete(),))]
    kept = [R.Rule(R.AttributeValue("processName", "konsole"), (R.AddTag("x"),))]
    counts = [
        dwelltrace.record(events, rules)._jdf.queryExecution().optimizedPlan().toString().count("regexp_") for rules in (kept, gone)
    ]
    assert counts[0] >= counts[1]


def test_unlocks_are_gathered_into_few_files(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for k in range(12):
        line = '{"type":"DeviceUnlockEventV1","time":"2031-01-01T00:00:%02dZ","data":{"hostname":"h"}}\n'
        (root / f"{k}.jsonl").write_text(line % k)
    outputs = run_pipeline(spark, _config(tmp_path), partition_bytes=1)
    assert spark.read.parquet(outputs.unlock_events).count() == 12
    assert len(files(outputs.unlock_events, ".parquet")) == 1


def test_jobs_leave_the_session_alone(spark, fixture_path, tmp_path):
    _two_file_root(fixture_path, tmp_path)
    before = spark.conf.getAll
    run_pipeline(spark, _config(tmp_path))
    dwelltrace.compact_logs(spark, str(tmp_path / "root"), str(tmp_path / "compact"))
    assert spark.conf.getAll == before


# -- names and bytes ---------------------------------------------------------------------


@pytest.mark.parametrize("name", ["_b.jsonl", "_archive/c.jsonl", ".hidden/d.jsonl.gz", "a/b/_c.jsonl"])
def test_logs_with_hidden_names_are_not_left_out_in_silence(spark, fixture_path, tmp_path, name):
    root = tmp_path / "root"
    (root / name).parent.mkdir(parents=True)
    shutil.copy(fixture_path("logs", "phones.jsonl"), root / "plain.jsonl")
    shutil.copy(fixture_path("logs", "phones.jsonl"), root / name)
    for call in (
        lambda: dwelltrace.read_log_root(spark, str(root)),
        lambda: dwelltrace.stream_logs(spark, str(root)),
        lambda: dwelltrace.compact_logs(spark, str(root), str(tmp_path / "target")),
    ):
        with pytest.raises(dwelltrace.NotALogError, match=name.rpartition("/")[2]):
            call()
    if name.rpartition("/")[2][0] in "_.":
        with pytest.raises(dwelltrace.NotALogError, match="passed over"):
            dwelltrace.read_logs(spark, [str(root / name)])


def test_bookkeeping_folders_are_no_logs(spark, fixture_path, tmp_path):
    shutil.copy(fixture_path("logs", "phones.jsonl"), tmp_path / "plain.jsonl")
    (tmp_path / "_temporary" / "0").mkdir(parents=True)
    shutil.copy(fixture_path("logs", "phones.jsonl"), tmp_path / "_temporary" / "0" / "part.jsonl")
    (tmp_path / "_SUCCESS").write_text("")
    assert dwelltrace.read_log_root(spark, str(tmp_path)).count() == 6


def test_compaction_keeps_bytes(spark, tmp_path):
    lines = [b"bad\x01line", b"\x02quoted\x02", b"broken \xff\xfe utf-8", b"a bare \r return", b'{"type":"X"}\r', b"  pad  "]
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "x.jsonl").write_bytes(b"\n".join(lines) + b"\n\n")
    dwelltrace.compact_logs(spark, str(tmp_path / "root"), str(tmp_path / "target"))
    got = [line for p in files(tmp_path / "target", ".jsonl.gz") for line in gzip.open(p, "rb")]
    assert sorted(got) == sorted(line + b"\n" for line in lines)


# -- layout by date ----------------------------------------------------------------------


def test_outputs_by_date(spark, fixture_path, tmp_path):
    _two_file_root(fixture_path, tmp_path)
    plain = multiset(spark.read.parquet(run_pipeline(spark, _config(tmp_path)).active_events))
    outputs = run_pipeline(spark, _config(tmp_path), partition_by_date=True)
    assert os.path.isdir(f"{outputs.active_events}/date=2040-11-05")
    assert multiset(spark.read.parquet(outputs.active_events).drop("date")) == plain


# -- configured jobs ---------------------------------------------------------------------


def test_recorder_from_its_configuration(spark, fixture_path, tmp_path):
    shutil.copytree(fixture_path("live"), tmp_path / "conf")
    feed = _feed(fixture_path, tmp_path)
    config = dwelltrace.load_job_config(str(tmp_path / "conf" / "main_config.json"), spark)

    def record(once=True):
        stream = dwelltrace.stream_runtime_events(spark, feed)
        return dwelltrace.start_configured_recorder(stream, config, checkpoint=str(tmp_path / "state"), once=once)

    dwelltrace.flush_and_stop(record(once=False), record)
    expected = sorted(open(fixture_path("live", "logged_expected.jsonl")).read().splitlines())
    assert sorted(text_of(tmp_path / "conf" / "recorded", ".jsonl").splitlines()) == expected


def test_bad_patterns_stop_a_stream_before_it_starts(spark, fixture_path, tmp_path):
    bad = [R.Rule(R.AttributeRegex("processName", r"\p{Script=Nowhere}"), (R.AddTag("x"),))]
    stream = dwelltrace.stream_runtime_events(spark, _feed(fixture_path, tmp_path))
    with pytest.raises(ValueError):
        dwelltrace.start_recorder(stream, bad, str(tmp_path / "l"), checkpoint=str(tmp_path / "s"))


def test_commands(spark, fixture_path, tmp_path, monkeypatch, capsys):
    _two_file_root(fixture_path, tmp_path)
    shutil.copytree(fixture_path("live"), tmp_path / "conf")
    feed, root = _feed(fixture_path, tmp_path), str(tmp_path / "root")

    def command(*words):
        monkeypatch.setattr("sys.argv", ["dwelltrace", *map(str, words)])
        runpy.run_module("dwelltrace", run_name="__main__")

    command("compact", root, tmp_path / "compact", "--upgrade")
    assert dwelltrace.read_log_root(spark, str(tmp_path / "compact")).count() == 13
    command("tables", _config(tmp_path), tmp_path / "a", tmp_path / "u", tmp_path / "state-t", "--once")
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "a")).count() == 10
    command("record", tmp_path / "conf" / "main_config.json", feed, tmp_path / "state-r", "--once")
    assert dwelltrace.read_log_root(spark, str(tmp_path / "conf" / "recorded")).count() == 5


def test_live_events_that_cannot_be_read(spark, write_log):
    whole = '{"activeWindowEvent":{"time":"2031-01-01T00:00:00Z","data":{"duration":1},"windowTitle":"x"}}'
    path = write_log(whole, whole[:60], '{"other":1}')
    with pytest.raises(PySparkException):
        dwelltrace.read_runtime_events(spark, path).collect()
    seen = Observation()
    assert dwelltrace.read_runtime_events(spark, path, on_corrupt="drop", dropped=seen).count() == 1
    assert seen.get["unreadable_lines"] == 1
    texts = spark.createDataFrame([(whole,), (whole[:60],), ("",)], "value string")
    assert dwelltrace.runtime_events_from_text(texts, on_corrupt="drop").count() == 1
    with pytest.raises(PySparkException):
        dwelltrace.runtime_events_from_text(texts).collect()
