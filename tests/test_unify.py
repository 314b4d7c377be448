"""Fixture logs of every event shape, boundary inputs, and policies for damaged lines."""

import datetime as dt
import gzip
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

import dwelltrace
from dwelltrace.functions.durations import duration_to_millis
from dwelltrace.schemas import ACTIVE_SCHEMA, UNLOCK_SCHEMA


def active(spark, *paths, **options):
    logs = dwelltrace.read_logs(spark, list(paths), **options)
    return dwelltrace.active_events_from(logs)


def rows(df):
    """Rows by time, durations in milliseconds."""
    millis = {c: duration_to_millis(F.col(c)) for c in ("duration", "idleFor")}
    return [r.asDict() for r in df.withColumns(millis).orderBy("time").collect()]


def column(df, name):
    return [r[name] for r in rows(df)]


def schema_of(df):
    return [(f.name, f.dataType) for f in df.schema.fields]


def test_names_come_from_paths(spark, fixture_path):
    df = active(spark, fixture_path("logs", "paths.jsonl"))
    assert schema_of(df) == [(f.name, f.dataType) for f in ACTIVE_SCHEMA.fields]
    assert column(df, "processName") == ["Sheet", "run", None, "editor", "Mixed.tar", "report.com", None]
    assert column(df, "name") == ["sheet", "run", None, "editor", "mixed.tar", "report.com", None]
    assert column(df, "processPath")[2:5] == ["/opt/tool/", "editor", "\\\\share\\x/y\\Mixed.tar.EXE"]
    assert column(df, "processPath")[6] is None
    assert column(df, "duration") == [30000, 30000, 750, 30000, 30000, 30000, 30000]
    assert column(df, "idleFor") == [0, 61500, 3599999, 1000, 2000, 60000, 600000]
    assert column(df, "tags") == [[], ["term", "root"], ["odd"], [], ["term"], [], []]
    for name, value in (("isMobile", False), ("ignore", False), ("category", None), ("applicationId", None), ("username", "ida")):
        assert column(df, name) == [value] * 7


def test_flat_keys(spark, fixture_path):
    df = active(spark, fixture_path("logs", "flat_keys.jsonl"))
    assert column(df, "processName") == ["Chess", None, "calc", None]
    assert column(df, "idleFor") == [200, None, 1000000, 8000]
    assert column(df, "duration") == [9000, 9000, None, 9500]
    assert column(df, "hostname") == ["barn", "barn", None, "barn"]
    assert column(df, "tags") == [["fun", "board"], [], [], []]


def test_times_are_utc_and_cut_to_microseconds(spark, fixture_path):
    unlocks = dwelltrace.unlock_events(spark, fixture_path("logs", "clock.jsonl"))
    assert {r.hostname: r.time for r in unlocks.collect()} == {
        "east": dt.datetime(2040, 2, 29, 18),
        "west": dt.datetime(2040, 1, 1, 3),
        "tenth": dt.datetime(2040, 6, 1, 10, 0, 0, 100000),
        "nano": dt.datetime(2040, 6, 1, 10, 0, 0, 123456),
        "micro": dt.datetime(2040, 6, 1, 10, 0, 0, 1),
        "never": None,
    }


def test_phones(spark, fixture_path):
    path = fixture_path("logs", "phones.jsonl")
    df = active(spark, path)
    assert column(df, "duration") == [600000, 130250, 5000]
    assert column(df, "name") == ["étude", "bus times", None]
    assert column(df, "applicationLabel") == ["ÉTUDE", "Bus Times", None]
    assert column(df, "applicationId") == ["app.etude", "app.bus", "app.nolabel"]
    for name, value in (("username", None), ("idleFor", None), ("tags", []), ("isMobile", True), ("processPath", None)):
        assert column(df, name) == [value] * 3
    unlocks = dwelltrace.unlock_events(spark, path)
    assert schema_of(unlocks) == [(f.name, f.dataType) for f in UNLOCK_SCHEMA.fields]
    assert sorted((r.time.minute, r.hostname) for r in unlocks.collect()) == [(9, "fold"), (29, None), (59, "fold")]


def test_all_kinds_in_one_file(spark, fixture_path):
    path = fixture_path("logs", "household.jsonl")
    df = active(spark, path)
    assert column(df, "name") == ["chess", "less", "most"]
    assert column(df, "isMobile") == [True, False, False]
    assert column(df, "idleFor") == [None, 2000, 6000]
    assert sorted(r.hostname for r in dwelltrace.unlock_events(spark, path).collect()) == ["tablet", "watch"]


def test_several_files_are_one_table(spark, fixture_path):
    names = ["paths", "phones", "flat_keys", "household"]
    df = active(spark, *[fixture_path("logs", f"{name}.jsonl") for name in names])
    assert df.count() == 7 + 3 + 4 + 3
    assert df.filter("isMobile").count() == 4
    assert df.filter(F.col("name") == "chess").count() == 2
    twice = active(spark, *[fixture_path("logs", "household.jsonl")] * 2)
    assert twice.count() == 6


def test_gzip_equals_plain(spark, fixture_path, tmp_path):
    plain = fixture_path("logs", "household.jsonl")
    packed = tmp_path / "household.jsonl.gz"
    with open(plain, "rb") as source, gzip.open(packed, "wb") as target:
        shutil.copyfileobj(source, target)
    assert rows(active(spark, str(packed))) == rows(active(spark, plain))


def test_root_is_searched_at_any_depth_for_log_names_only(spark, fixture_path, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    shutil.copy(fixture_path("logs", "paths.jsonl"), deep / "x.jsonl")
    shutil.copy(fixture_path("logs", "phones.jsonl"), tmp_path / "y.jsonl")
    (tmp_path / "main_config.json").write_text('{\n "a": 1\n}')
    df = dwelltrace.active_events_from(dwelltrace.read_log_root(spark, str(tmp_path), on_corrupt="file"))
    assert df.count() == 10


@pytest.mark.parametrize("policy", ["line", "file"])
def test_a_file_that_is_not_a_log_is_refused(spark, fixture_path, policy):
    with pytest.raises((PySparkException, dwelltrace.NotALogError)):
        active(spark, fixture_path("live", "main_config.json"), on_corrupt=policy).collect()


def test_missing_file_is_refused(spark, fixture_path):
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        active(spark, fixture_path("logs", "does_not_exist.jsonl")).collect()


@pytest.mark.parametrize("policy", ["line", "file", "drop"])
def test_empty_file_and_no_files(spark, fixture_path, policy):
    for paths in ([fixture_path("logs", "empty.jsonl")], []):
        logs = dwelltrace.read_logs(spark, paths, on_corrupt=policy)
        for df, schema in [
            (dwelltrace.active_events_from(logs), ACTIVE_SCHEMA), (dwelltrace.unlock_events_from(logs), UNLOCK_SCHEMA),
        ]:
            assert df.count() == 0
            assert df.columns == schema.fieldNames()


GOOD = '{"type":"DeviceUnlockEventV1","time":"2026-01-01T00:00:00Z","data":{"hostname":"a"}}'
TORN = '{"type":"DeviceUnlockEventV1","time":"2026-01-01T00:0'


def test_torn_line_policies(spark, write_log):
    path = write_log(GOOD, TORN)
    with pytest.raises(PySparkException, match="not a JSON object"):
        dwelltrace.unlock_events(spark, path).collect()
    assert dwelltrace.unlock_events(spark, path, on_corrupt="file").count() == 1
    seen = Observation()
    logs = dwelltrace.read_logs(spark, path, on_corrupt="drop", dropped=seen)
    assert dwelltrace.unlock_events_from(logs).count() == 1
    assert seen.get["unreadable_lines"] == 1


def test_the_complaint_does_not_quote_the_line(spark, write_log):
    with pytest.raises(PySparkException) as error:
        dwelltrace.unlock_events(spark, write_log(GOOD, '{"secret title')).collect()
    assert "secret" not in str(error.value)


def test_file_policy_names_the_foreign_file_only(spark, write_log):
    good, foreign = write_log(GOOD, TORN), write_log("{", '"a": 1', "}", name="foreign.jsonl")
    with pytest.raises(dwelltrace.NotALogError, match="foreign.jsonl") as error:
        dwelltrace.read_logs(spark, [good, foreign], on_corrupt="file")
    assert "log.jsonl" not in str(error.value)


def test_types_are_skipped_in_the_reader_but_torn_lines_are_not(spark, write_log):
    path = write_log(GOOD, '{"type":"ActiveActivityEventV1","time":"2026-01-01T00:00:00Z"}')
    df = dwelltrace.unlock_events(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(type)," in plan
    assert df.count() == 1


def test_malformed_values_become_null_alone(spark, write_log):
    line = '{"type":"ActiveWindowEvent","time":"2026-01-01T00:00:00Z","duration":"x","hostname":"h","tags":["a"]}'
    (row,) = rows(active(spark, write_log(line)))
    assert (row["duration"], row["hostname"], row["tags"]) == (None, "h", ["a"])


def test_unknown_and_missing_types_are_left_out(spark, write_log):
    path = write_log('{"type":"SomethingV9","time":"2026-01-01T00:00:00Z"}', '{"time":"2026-01-01T00:00:00Z"}', GOOD)
    assert active(spark, path).count() == 0
    assert dwelltrace.unlock_events(spark, path).count() == 1


def test_nested_values_win_over_flat_ones(spark, write_log):
    line = (
        '{"type":"ActiveWindowEventV1","time":"2026-01-01T00:00:00Z","duration":1,"hostname":"flat","tags":["f"],'
        '"data":{"duration":2,"hostname":"nested"}}'
    )
    (row,) = rows(active(spark, write_log(line)))
    assert (row["duration"], row["hostname"], row["tags"]) == (2000, "nested", ["f"])


def test_offsets_and_daylight_saving_do_not_shift_times(spark, write_log):
    times = ["2026-03-08T02:30:00Z", "2026-11-01T01:30:00Z", "2026-11-01T05:30:00+00:00", "2026-11-01T08:30:00+02:00"]
    path = write_log(*[GOOD.replace("2026-01-01T00:00:00Z", t) for t in times])
    got = sorted(r.time for r in dwelltrace.unlock_events(spark, path).collect())
    assert got == [
        dt.datetime(2026, 3, 8, 2, 30), dt.datetime(2026, 11, 1, 1, 30),
        dt.datetime(2026, 11, 1, 5, 30), dt.datetime(2026, 11, 1, 6, 30),
    ]


@pytest.mark.parametrize(
    "seconds, millis",
    [("1.9999", 1999), ("-1.9999", -1999), ("0.0004", 0), ("15", 15000), ("1e300", None), ("9.3e15", None)],
)
def test_durations_are_cut_and_never_fail(spark, write_log, seconds, millis):
    line = f'{{"type":"ActiveWindowEvent","time":"2026-01-01T00:00:00Z","duration":{seconds}}}'
    (row,) = rows(active(spark, write_log(line)))
    assert row["duration"] == millis


def test_source_file_can_be_carried_along(spark, fixture_path):
    path = fixture_path("logs", "phones.jsonl")
    df = active(spark, path, with_source=True)
    assert df.columns == [*ACTIVE_SCHEMA.fieldNames(), "source_file"]
    assert {r.source_file.rsplit("/", 1)[1] for r in df.collect()} == {"phones.jsonl"}


def test_tables_need_no_shuffle_and_no_python(spark, fixture_path):
    path = fixture_path("logs", "phones.jsonl")
    for df in (dwelltrace.active_events(spark, path), dwelltrace.unlock_events(spark, path)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["paths", "flat_keys", "phones", "household"])
def test_a_line_torn_anywhere_gives_no_event(spark, fixture_path, write_log, name):
    whole = open(fixture_path("logs", f"{name}.jsonl")).read().splitlines()
    torn = [line[:cut] for line in whole for cut in range(1, len(line))]
    path = write_log(*whole, *torn)
    expected = [fixture_path("logs", f"{name}.jsonl")]
    for table in (dwelltrace.active_events, dwelltrace.unlock_events):
        for policy in ("drop", "file"):
            assert rows_of(table(spark, path, on_corrupt=policy)) == rows_of(table(spark, expected))
    seen = Observation()
    dwelltrace.read_logs(spark, path, on_corrupt="drop", dropped=seen).count()
    assert seen.get["unreadable_lines"] == len(torn)


def rows_of(df):
    return sorted(repr(tuple(row)) for row in df.collect())


def test_each_torn_line_is_refused(spark, write_log):
    line = '{"type":"ActiveActivityEventV1","time":"2031-01-01T00:00:00Z","data":{"duration":3,"hostname":"h"}}'
    for cut in (1, 20, 40, 70, 79, 85, 90, 98, len(line) - 1):
        path = write_log(line, line[:cut], name=f"cut{cut}.jsonl")
        with pytest.raises(PySparkException, match="not a JSON object"):
            dwelltrace.active_events(spark, path).collect()
