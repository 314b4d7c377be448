"""How outputs are laid out: clustered tables, compacted logs, lists of refused lines."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import dwelltrace
from dwelltrace import files
from dwelltrace.plans.etl import run_pipeline
from dwelltrace.sources.config import JobConfig


def config(tmp_path, output_format="parquet"):
    return JobConfig(str(tmp_path / "logs"), str(tmp_path / "logs"), 15, 3600, str(tmp_path / "out"), output_format)


def unlock(k, host="h"):
    return json.dumps({"type": "DeviceUnlockEventV1", "time": f"2031-01-01T00:00:{k % 60:02d}Z", "data": {"hostname": host}})


def log(tmp_path, name, *lines):
    path = tmp_path / "logs" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))


# -- clustered tables ------------------------------------------------------------------------


def rows_scanned(df):
    """Rows that came out of the scan of a table, before its filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    while leaves.size() == 1 and leaves.head().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        leaves = leaves.head().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def hosts(spark):
    """Forty hosts, their rows in no order."""
    rows = spark.range(120_000).withColumn("hostname", F.concat(F.lit("host"), F.pmod(F.xxhash64("id"), F.lit(40))))
    return rows.withColumn("time", F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6))).cast("timestamp_ntz"))


@pytest.mark.parametrize("by_date", [False, True])
def test_one_host_is_few_row_groups(spark, hosts, tmp_path, by_date):
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)
    small = {"parquet.block.size": "16384", "parquet.page.size": "2048", "parquet.block.size.row.check.min": "100"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in small.items():
        hadoop.set(key, value)
    try:
        dwelltrace.write_table(hosts, plain, "parquet", partition_by_date=by_date)
        dwelltrace.write_table(hosts, clustered, "parquet", partition_by_date=by_date, cluster_by=["hostname", "time"])
    finally:
        for key in small:
            hadoop.unset(key)
        spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    wanted = hosts.filter("hostname = 'host7'").count()
    asked = {path: spark.read.parquet(path).filter("hostname = 'host7'") for path in (plain, clustered)}
    assert asked[plain].count() == asked[clustered].count() == wanted
    assert rows_scanned(asked[clustered]) < 4 * wanted < rows_scanned(asked[plain]) / 4


def test_clustering_changes_no_row(spark, hosts, tmp_path):
    dwelltrace.write_table(hosts, str(tmp_path / "t"), "parquet", cluster_by=["hostname", "time"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == hosts.count() and back.exceptAll(hosts).isEmpty()


# -- compaction ------------------------------------------------------------------------------


def sizes(folder):
    return [len(gzip.open(path).read()) for path in glob.glob(f"{folder}/*.jsonl.gz")]


@pytest.mark.parametrize("target", [60_000, 150_000])
def test_compacted_files_are_near_their_size(spark, tmp_path, target):
    """Many small logs and a large one; the number of cores plays no part."""
    for k in range(150):
        log(tmp_path, f"{k % 7}/{k}.jsonl", *[unlock(i, f"host{k}") for i in range(20 + k % 30)])
    log(tmp_path, "large.jsonl", *[unlock(i) for i in range(5_000)])
    dwelltrace.compact_logs(spark, str(tmp_path / "logs"), str(tmp_path / "compact"), partition_bytes=target)
    found = sizes(tmp_path / "compact")
    total = sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/logs/**/*.jsonl", recursive=True))
    assert sum(found) == total
    near = [size for size in found if abs(size - target) < 0.2 * target]
    assert len(near) >= len(found) - 1  # one file holds what is left over
    assert len(found) <= round(total / target) + 1


def test_no_file_is_renamed_by_the_driver(spark, tmp_path, monkeypatch):
    log(tmp_path, "a.jsonl", *[unlock(k) for k in range(50)])
    moved = []
    original = files.replace_all
    monkeypatch.setattr(files, "replace_all", lambda spark, new: moved.append(dict(new)) or original(spark, new))
    dwelltrace.compact_logs(spark, str(tmp_path / "logs"), str(tmp_path / "compact"), partition_bytes=500)
    assert [list(new) for new in moved] == [[str(tmp_path / "compact")]]
    assert all(name.endswith(".jsonl.gz") for name in os.listdir(tmp_path / "compact") if name[0] not in "._")


def test_every_byte_comes_through(spark, tmp_path):
    every = bytes(b for b in range(256) if b != 10)
    lines = [every, every.replace(b"\r", b"") + b"\xee\x80\x80 \xef\xbf\xbf", "  ".encode(), b'"', b"''", b"\\", b"#", b"\xff" * 3, b"a,b;c\td"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.jsonl").write_bytes(b"\n".join(lines))
    dwelltrace.compact_logs(spark, str(tmp_path / "logs"), str(tmp_path / "compact"))
    got = [line for path in glob.glob(f"{tmp_path}/compact/**/*.jsonl.gz", recursive=True) for line in gzip.open(path)]
    assert sorted(got) == sorted(line + b"\n" for line in lines)


# -- replacing -------------------------------------------------------------------------------


def test_tables_that_cannot_both_be_replaced_stay(spark, tmp_path, monkeypatch):
    log(tmp_path, "a.jsonl", unlock(1))
    outputs = run_pipeline(spark, config(tmp_path))
    before = sorted(glob.glob(f"{tmp_path}/out/**", recursive=True))
    log(tmp_path, "b.jsonl", unlock(2))
    original = files.replace_all

    def second_place_is_taken(session, new):
        new = dict(new)
        new[outputs.unlock_events] = str(tmp_path / "not there")
        return original(session, new)

    monkeypatch.setattr("dwelltrace.plans.etl.replace_all", second_place_is_taken)
    with pytest.raises(dwelltrace.JobError):
        run_pipeline(spark, config(tmp_path))
    assert sorted(glob.glob(f"{tmp_path}/out/**", recursive=True)) == before
    assert spark.read.parquet(outputs.unlock_events).count() == 1


# -- refused lines ---------------------------------------------------------------------------


def test_refused_lines_are_listed_without_their_text(spark, tmp_path):
    secret = '{"type":"ActiveWindowEventV1","windowTitle":"my bank'
    log(tmp_path, "a.jsonl", unlock(1), secret, "  [1]", unlock(2))
    log(tmp_path, "b/c.jsonl", unlock(3), "{", "plain text")
    outputs = run_pipeline(spark, config(tmp_path), scan="staged", list_refused=True)
    rows = spark.read.parquet(outputs.refused_lines).collect()
    assert sorted((r.source_file.rsplit("/", 1)[1], r.bytes, r.reason, r.block_start) for r in rows) == [
        ("a.jsonl", 5, "not an object", 0), ("a.jsonl", len(secret), "torn", 0),
        ("c.jsonl", 1, "torn", 0), ("c.jsonl", 10, "not an object", 0),
    ]
    assert "bank" not in "".join(open(p, "rb").read().decode("latin-1") for p in glob.glob(f"{outputs.refused_lines}/*.parquet"))
    assert spark.read.parquet(outputs.unlock_events).count() == 3
    seen = Observation()
    dwelltrace.read_log_root(spark, str(tmp_path / "logs"), on_corrupt="drop", dropped=seen).count()
    assert seen.get["unreadable_lines"] == len(rows)


def test_refused_lines_need_the_staged_copy(spark, tmp_path):
    with pytest.raises(ValueError, match="staged"):
        run_pipeline(spark, config(tmp_path), list_refused=True)


def test_no_refused_lines(spark, tmp_path):
    log(tmp_path, "a.jsonl", unlock(1))
    outputs = run_pipeline(spark, config(tmp_path, "csv"), scan="staged", list_refused=True)
    assert spark.read.option("header", True).csv(outputs.unlock_events).count() == 1
    assert os.path.isdir(outputs.refused_lines)


# -- discovery -------------------------------------------------------------------------------


def test_hidden_names_are_found_without_listing_the_rest(spark, tmp_path):
    for k in range(300):
        log(tmp_path, f"d{k % 10}/{k}.jsonl", unlock(k))
    assert files.hidden_files(spark, [str(tmp_path)], (".jsonl",)) == []
    log(tmp_path, "d3/.later/x/y.jsonl", unlock(1))
    log(tmp_path, "d4/_z.jsonl", unlock(1))
    log(tmp_path, "d4/_notes/readme.txt", "no log")
    found = files.hidden_files(spark, [str(tmp_path)], (".jsonl",))
    assert sorted(os.path.basename(path) for path in found) == ["_z.jsonl", "y.jsonl"]
    assert len(files.hidden_files(spark, [str(tmp_path)], (".jsonl",), at_most=1)) == 1
    assert files.hidden_files(spark, [str(tmp_path / "nowhere")], (".jsonl",)) == []
    assert len(files.hidden_files(spark, [f"{tmp_path}/logs/*/_*"], (".jsonl",))) == 1


@pytest.mark.parametrize("name", ["_b.jsonl", ".c.jsonl", "deep/_d.json"])
def test_hidden_live_events_are_refused(spark, tmp_path, name):
    event = '{"activeWindowEvent":{"time":"2031-01-01T00:00:00Z","data":{"duration":1},"windowTitle":"x"}}'
    log(tmp_path, "a.jsonl", event)
    log(tmp_path, name, event)
    folder = str(tmp_path / "logs")
    for read in (dwelltrace.read_runtime_events, dwelltrace.stream_runtime_events):
        with pytest.raises(dwelltrace.NotALogError, match=os.path.basename(name)):
            read(spark, folder)
    with pytest.raises(dwelltrace.NotALogError):
        dwelltrace.read_runtime_events(spark, f"{folder}/{name}")
    assert dwelltrace.read_runtime_events(spark, f"{folder}/a.jsonl").count() == 1


def test_a_recorder_ends_when_live_events_come_under_a_hidden_name(spark, tmp_path):
    event = '{"activeWindowEvent":{"time":"2031-01-01T00:00:00Z","data":{"duration":1},"windowTitle":"x"}}'
    log(tmp_path, "a.jsonl", event)
    folder = str(tmp_path / "logs")
    query = dwelltrace.start_recorder(
        dwelltrace.stream_runtime_events(spark, folder), [], str(tmp_path / "out"), checkpoint=str(tmp_path / "state"),
        every_sec=0.2, source_folder=folder,
    )
    query.processAllAvailable()
    log(tmp_path, "_b.jsonl", event)
    log(tmp_path, "c.jsonl", event)
    with pytest.raises(Exception, match="_b.jsonl"):
        query.processAllAvailable()


def test_a_run_over_logs_without_unlocks(spark, tmp_path):
    log(tmp_path, "a.jsonl", '{"type":"ActiveWindowEventV1","time":"2031-01-01T00:00:00Z","data":{"duration":1}}')
    outputs = run_pipeline(spark, config(tmp_path))
    assert (spark.read.parquet(outputs.active_events).count(), spark.read.parquet(outputs.unlock_events).count()) == (1, 0)
