"""Versioned tables and the incremental job, against whole runs over the same logs."""

import json
import os
import random
import shutil
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import dwelltrace
from dwelltrace.operators import rules as R
from dwelltrace.operators.rule_changes import compare, reached_columns, reached_rows
from dwelltrace.plans import incremental
from dwelltrace.sinks import snapshots
from dwelltrace.sources.config import parse_rules_text, rules_as_text


def window(when, host="h", path="/usr/bin/vim", idle=0, tags=(), seconds=10):
    data = {"duration": seconds, "hostname": host, "username": "u", "idleFor": idle, "processPath": path, "tags": list(tags)}
    return json.dumps({"type": "ActiveWindowEventV1", "time": when, "data": data})


def unlock(when, host="p"):
    return json.dumps({"type": "DeviceUnlockEventV1", "time": when, "data": {"hostname": host}})


def day(number, second=0):
    return f"2031-05-{number:02d}T08:00:{second:02d}Z"


RULES = [
    {"predicate": {"attributeRegex": {"name": "name", "regex": "vim|emacs"}}, "actions": [{"addTag": "edit"}]},
    {"predicate": {"hasTag": "edit"}, "actions": [{"setAttribute": {"name": "category", "value": "work"}}]},
    {"predicate": {"idleForGreaterThanSec": 60}, "actions": ["ignore", {"setAttribute": {"name": "name", "value": "idle"}}]},
]


class Place:
    """A log folder, a rule file and an output folder."""

    def __init__(self, spark, tmp_path):
        self.spark, self.base = spark, tmp_path
        (tmp_path / "logs").mkdir()
        self.rules(RULES)
        main = {
            "logDirectory": "logs", "logOutputSubdirectory": ".", "sampleEverySec": 15, "writeEverySec": 3600,
            "pipelineConfigPath": "rules.json", "pipelineOutputDirectory": "out", "pipelineOutputFormat": "parquet",
        }
        (tmp_path / "main.json").write_text(json.dumps(main))
        self.out = str(tmp_path / "out")

    def rules(self, rules):
        self.rule_list = rules
        (self.base / "rules.json").write_text(json.dumps({"activeEventRules": rules, "activeEventMaxDuration": 60}))

    def log(self, name, *lines):
        path = self.base / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(line + "\n" for line in lines))

    def run(self, **options):
        return dwelltrace.run_incremental(self.spark, str(self.base / "main.json"), **options)

    def rows(self, **options):
        return (
            sorted(map(repr, dwelltrace.read_active(self.spark, self.out, **options).collect())),
            sorted(map(repr, dwelltrace.read_unlocks(self.spark, self.out, **options).collect())),
        )

    def whole(self):
        """What a run over everything gives."""
        logs = dwelltrace.read_log_root(self.spark, str(self.base / "logs"), on_corrupt="drop")
        rules = dwelltrace.parse_transform_config({"activeEventRules": self.rule_list, "activeEventMaxDuration": 60}).rules
        active = dwelltrace.apply_rules(dwelltrace.active_events_from(logs), rules)
        return sorted(map(repr, active.collect())), sorted(map(repr, dwelltrace.unlock_events_from(logs).collect()))


@pytest.fixture
def place(spark, tmp_path):
    return Place(spark, tmp_path)


# -- versions --------------------------------------------------------------------------------


def test_versions_of_an_empty_folder(spark, tmp_path):
    assert snapshots.latest(spark, str(tmp_path / "none")) == snapshots.Snapshot()
    assert dwelltrace.read_active(spark, str(tmp_path / "none")).count() == 0
    assert dwelltrace.read_unlocks(spark, str(tmp_path / "none")).columns == ["time", "hostname"]


def test_two_writers_cannot_take_the_same_number(spark, tmp_path):
    folder = str(tmp_path)
    first = snapshots.commit(spark, folder, snapshots.Snapshot(notes={"by": "a"}))
    assert first.version == 1
    with pytest.raises(dwelltrace.SnapshotConflict):
        snapshots.commit(spark, folder, snapshots.Snapshot(notes={"by": "b"}))
    assert snapshots.latest(spark, folder).notes == {"by": "a"}
    added = snapshots.commit_addition(spark, folder, lambda s: s.with_notes(also="c"))
    assert (added.version, dict(added.notes)) == (2, {"by": "a", "also": "c"})


def test_an_addition_is_made_again_on_top_of_another(spark, tmp_path):
    folder, calls = str(tmp_path), []

    def change(snapshot):
        if not calls:
            snapshots.commit(spark, folder, snapshot.with_notes(other=1))
        calls.append(snapshot.version)
        return snapshot.with_notes(own=1)

    assert dict(snapshots.commit_addition(spark, folder, change).notes) == {"other": 1, "own": 1}
    assert calls == [0, 1]


def test_a_manifest_that_is_not_whole_is_passed_over(spark, tmp_path):
    folder = str(tmp_path)
    snapshots.commit(spark, folder, snapshots.Snapshot(notes={"n": 1}))
    broken = tmp_path / "versions" / "000000000002.json"
    broken.write_text('{"tables": {')
    assert snapshots.latest(spark, folder).version == 1
    with pytest.raises(dwelltrace.SnapshotConflict):  # someone may still be writing it
        snapshots.commit(spark, folder, snapshots.latest(spark, folder))
    old = time.time() - 3600
    os.utime(broken, (old, old))
    assert snapshots.commit(spark, folder, snapshots.latest(spark, folder)).version == 3


# -- incremental runs ------------------------------------------------------------------------


def test_only_new_files_are_read(place):
    place.log("a.jsonl", window(day(1)), unlock(day(1)))
    place.log("sub dir/b[1].jsonl", window(day(2), path="/bin/top", idle=90))
    assert place.run() == incremental.Progress(1, 2, 0, 0)
    assert place.rows() == place.whole()
    assert place.run() == incremental.Progress(1, 0, 0, 0)
    place.log("c {x}.jsonl", window(day(2, 5), path=r"C:\emacs.exe"), unlock(day(3)), window("never"))
    assert place.run() == incremental.Progress(2, 1, 0, 0)
    assert place.rows() == place.whole()
    assert len(place.rows()[0]) == 4
    assert len(place.rows(version=1)[0]) == 2


def test_the_second_run_opens_only_new_files(place, monkeypatch):
    place.log("a.jsonl", window(day(1)))
    place.run()
    asked = []
    original = incremental.read_logs
    monkeypatch.setattr(incremental, "read_logs", lambda spark, paths, **o: asked.extend(paths) or original(spark, paths, **o))
    monkeypatch.setattr(incremental, "read_log_root", lambda *a, **o: pytest.fail("the whole root was read"))
    place.log("b.jsonl", window(day(2)))
    place.run()
    assert {os.path.basename(path) for path in asked} == {"b.jsonl"}


def test_changed_and_removed_files_lose_their_rows(place):
    place.log("a.jsonl", window(day(1)), unlock(day(4)))
    place.log("b.jsonl", window(day(1, 1)), window(day(2)), window("no time"))
    place.log("c.jsonl", window(day(9)))
    place.run()
    before = snapshots.latest(place.spark, place.out)
    place.log("b.jsonl", window(day(1, 1)), window(day(3)), unlock(day(3)))
    os.remove(place.base / "logs" / "a.jsonl")
    assert place.run() == incremental.Progress(2, 1, 2, 0)
    assert place.rows() == place.whole()
    after = snapshots.latest(place.spark, place.out)
    assert after.tables["active_events"]["2031-05-09"] == before.tables["active_events"]["2031-05-09"]
    assert after.days("active_events") == ["2031-05-01", "2031-05-03", "2031-05-09"]


def test_a_grown_file_is_read_again(place):
    place.log("now.jsonl", window(day(1)))
    for second in range(1, 4):
        place.run()
        place.log("now.jsonl", *[window(day(1, k)) for k in range(second + 1)])
    place.run()
    assert place.rows() == place.whole()


def test_days_of_many_parts_are_gathered(place):
    for k in range(5):
        place.log(f"{k}.jsonl", window(day(1, k)), unlock(day(1, k)))
        place.run(most_parts=3)
    assert place.rows() == place.whole()
    parts = snapshots.latest(place.spark, place.out).tables
    assert len(parts["active_events"]["2031-05-01"]) == len(parts["unlock_events"]["2031-05-01"]) == 2


def test_many_new_files_are_read_through_the_root(place):
    place.log("a.jsonl", window(day(1)))
    place.run()
    for k in range(4):
        place.log(f"more{k}.jsonl", window(day(2, k)))
    assert place.run(read_whole_above=3).files_read == 4
    assert place.rows() == place.whole()
    assert place.run() == incremental.Progress(2, 0, 0, 0)


def test_a_file_that_comes_while_logs_are_read_is_not_counted_twice(place, monkeypatch):
    place.log("a.jsonl", window(day(1)))
    original = incremental.read_log_root

    def late(*args, **options):
        place.log("late.jsonl", window(day(1, 7)))
        return original(*args, **options)

    monkeypatch.setattr(incremental, "read_log_root", late)
    place.run()
    monkeypatch.undo()
    place.run()
    assert place.rows() == place.whole()
    assert len(place.rows()[0]) == 2


def test_a_run_that_fails_between_the_tables_shows_both_old_ones(place, monkeypatch):
    place.log("a.jsonl", window(day(1)), unlock(day(1)))
    place.run()
    before = place.rows()
    place.log("b.jsonl", window(day(2)), unlock(day(2)))
    written = []
    original = snapshots.write_parts

    def fails_at_the_second(df, folder, run, table):
        written.append(table)
        if table == "unlock_events":
            raise OSError("disk full")
        return original(df, folder, run, table)

    monkeypatch.setattr(snapshots, "write_parts", fails_at_the_second)
    with pytest.raises(dwelltrace.JobError, match="disk full"):
        place.run()
    assert written == ["active_events", "unlock_events"]
    assert place.rows() == before
    monkeypatch.undo()
    place.run()
    assert place.rows() == place.whole() != before


@pytest.mark.parametrize("policy", ["file", "line"])
def test_a_foreign_file_changes_nothing(place, policy):
    place.log("a.jsonl", window(day(1)))
    place.run()
    before = place.rows()
    place.log("foreign.jsonl", "{", '  "setting": 1', "}")
    with pytest.raises(dwelltrace.JobError):
        place.run(on_corrupt=policy)
    assert place.rows() == before
    place.run(on_corrupt="drop")
    assert place.rows() == before


def test_odd_calls(place):
    with pytest.raises(dwelltrace.JobError, match="missing"):
        dwelltrace.run_incremental(place.spark, str(place.base / "missing.json"))
    with pytest.raises(ValueError):
        place.run(on_corrupt="sometimes")
    assert place.run() == incremental.Progress(1, 0, 0, 0)
    assert place.rows() == ([], [])
    place.log("_hidden.jsonl", window(day(1)))
    with pytest.raises(dwelltrace.JobError, match="_hidden"):
        place.run()


def test_days_are_read_by_name(place):
    place.log("a.jsonl", *[window(day(k)) for k in range(1, 6)], window("never"), *[unlock(day(k)) for k in range(1, 6)])
    place.run()
    read = dwelltrace.read_active(place.spark, place.out, first_day="2031-05-02", last_day="2031-05-03")
    assert sorted(r.time.day for r in read.collect()) == [2, 3]
    assert len(read.inputFiles()) == 2
    assert dwelltrace.read_unlocks(place.spark, place.out, first_day="2031-05-05").count() == 1


def test_settings_of_reading(place):
    phone = {"duration": 200, "hostname": "p", "applicationLabel": "Maps", "applicationId": "m"}
    place.log("a.jsonl", window(day(1), idle=99), json.dumps({"type": "ActiveActivityEventV1", "time": day(1), "data": phone}))
    place.run()
    assert dwelltrace.read_active(place.spark, place.out, drop_ignored=True).count() == 1
    assert dwelltrace.read_active(place.spark, place.out, max_seconds=60).count() == 1 + 4


def test_old_versions_are_forgotten(place):
    for k in range(4):
        place.log("a.jsonl", *[window(day(1, s)) for s in range(k + 1)])
        place.run()
    assert dwelltrace.forget_versions(place.spark, place.out, keep=2) == [2, 1]
    assert place.rows() == place.whole()
    assert len(place.rows(version=3)[0]) == 3
    kept = {p for s in (3, 4) for p in snapshots.load(place.spark, place.out, s).tables["active_events"]["2031-05-01"]}
    on_disk = [d for d, _, names in os.walk(f"{place.out}/data") if "active_events/date=" in d and names]
    assert len(on_disk) == len(kept)
    with pytest.raises(ValueError):
        dwelltrace.forget_versions(place.spark, place.out, keep=0)


# -- changed rules ---------------------------------------------------------------------------


def test_a_changed_rule_runs_again_where_it_can_reach(place):
    place.log("a.jsonl", window(day(1)), window(day(2), path="/bin/top"), window(day(3), path="/bin/emacs", idle=70))
    place.run()
    before = snapshots.latest(place.spark, place.out).tables["active_events"]
    changed = [RULES[0], {"predicate": {"hasTag": "edit"}, "actions": [{"setAttribute": {"name": "category", "value": "play"}}]}, RULES[2]]
    place.rules(changed)
    assert place.run() == incremental.Progress(2, 0, 0, 2)
    assert place.rows() == place.whole()
    after = snapshots.latest(place.spark, place.out).tables["active_events"]
    assert [d for d in before if before[d] != after[d]] == ["2031-05-01", "2031-05-03"]


def test_rows_out_of_reach_are_not_evaluated(place, monkeypatch):
    place.log("a.jsonl", *[window(day(1, k), path="/bin/top") for k in range(20)], window(day(1, 30)))
    place.run()
    seen = []
    original = incremental.apply_rules
    monkeypatch.setattr(incremental, "apply_rules", lambda df, rules: seen.append(df.count()) or original(df, rules))
    place.rules([*RULES, {"predicate": {"attributeValue": {"name": "processName", "value": "vim"}}, "actions": ["ignore"]}])
    place.run()
    assert seen == [1]
    monkeypatch.undo()
    assert place.rows() == place.whole()


def test_rules_and_files_change_together_and_back(place):
    place.log("a.jsonl", window(day(1)), window(day(2), path="/x/emacs", idle=300, tags=["edit"]))
    place.run()
    first = place.rows()
    place.log("b.jsonl", window(day(1, 3)), window(day(7), path=None))
    place.rules([{"predicate": {"attributeRegex": {"name": "hostname", "regex": "^h"}}, "actions": [{"setAttribute": {"name": "hostname", "value": "z"}}]}, *RULES[::-1]])
    place.run()
    assert place.rows() == place.whole()
    os.remove(place.base / "logs" / "b.jsonl")
    place.rules(RULES)
    place.run()
    assert place.rows() == place.whole() == first


def test_a_rule_without_effect_costs_no_data(place):
    place.log("a.jsonl", window(day(1)))
    place.run()
    before = snapshots.latest(place.spark, place.out).tables
    place.rules([*RULES, {"predicate": {"attributeValue": {"name": "name", "value": "nobody has it"}}, "actions": ["ignore"]}])
    assert place.run() == incremental.Progress(2, 0, 0, 0)
    assert snapshots.latest(place.spark, place.out).tables == before


ATTRIBUTES = ["hostname", "name", "category", "processName"]


def some_rules(rng, n):
    def predicate(depth=0):
        kind = rng.randrange(7 if depth < 2 else 4)
        if kind == 0:
            return R.AttributeValue(rng.choice(ATTRIBUTES), rng.choice("xyz"))
        if kind == 1:
            return R.AttributeRegex(rng.choice(ATTRIBUTES), rng.choice(["x", "y|z", "^x$"]))
        if kind == 2:
            return R.HasTag(rng.choice("tuv"))
        if kind == 3:
            return rng.choice([R.IsMobile(), R.IdleForGreaterThan(rng.choice([0, 50]))])
        if kind == 4:
            return R.Not(predicate(depth + 1))
        parts = tuple(predicate(depth + 1) for _ in range(rng.randrange(4)))
        return R.And(parts) if kind == 5 else R.Or(parts)

    def action():
        return rng.choice(
            [R.AddTag(rng.choice("tuv")), R.SetAttribute(rng.choice(ATTRIBUTES), rng.choice("xyz")), R.Ignore()]
        )

    return [R.Rule(predicate(), tuple(action() for _ in range(rng.randrange(3)))) for _ in range(n)]


@pytest.fixture(scope="module")
def all_rows(spark):
    """Rows of all small combinations of values."""
    some = ["x", "y", None]
    frame = spark.sql("SELECT 1 AS k")
    for name, values in (("hostname", some), ("name", some), ("category", [None]), ("processName", ["x", None]), ("isMobile", [True, False])):
        frame = frame.withColumn(name, F.explode(F.array(*[F.lit(v).cast("boolean" if name == "isMobile" else "string") for v in values])))
    frame = frame.withColumn("idleFor", F.explode(F.expr("array(INTERVAL '0 00:01:00' DAY TO SECOND, CAST(NULL AS INTERVAL DAY TO SECOND))")))
    frame = frame.withColumn("tags", F.explode(F.expr("array(array('t'), CAST(array() AS array<string>))"))).withColumn("ignore", F.lit(False))
    frame = frame.drop("k").withColumn("id", F.monotonically_increasing_id())
    return spark.createDataFrame(frame.collect(), frame.schema)


@pytest.mark.parametrize("seed", range(12))
def test_rows_out_of_reach_come_out_as_before(spark, all_rows, seed):
    rng = random.Random(seed)
    before = some_rules(rng, 6)
    after = list(before)
    for _ in range(rng.randint(1, 2)):
        what = rng.randrange(4)
        at = rng.randrange(len(after))
        if what == 0:
            after[at] = some_rules(rng, 1)[0]
        elif what == 1:
            del after[at]
        elif what == 2:
            after.insert(at, some_rules(rng, 1)[0])
        else:
            after.insert(rng.randrange(len(after)), after.pop(at))
    change = compare(before, after)
    judged = all_rows.withColumn("reached", reached_rows(change))
    old = {r.id: r for r in dwelltrace.apply_rules(judged, before).collect()}
    new = {r.id: r for r in dwelltrace.apply_rules(judged, after).collect()}
    differ = {i for i in old if old[i] != new[i]}
    assert differ <= {i for i, r in old.items() if r.reached}
    columns = {c for i in differ for c in old[i].asDict() if old[i][c] != new[i][c]}
    assert columns <= reached_columns(change)


def test_equal_lists_change_nothing():
    rules = some_rules(random.Random(1), 8)
    assert not compare(rules, list(rules))
    assert not compare(rules, [*rules, R.Rule(R.IsMobile(), ())])
    assert compare(rules, rules[::-1])
    assert parse_rules_text(rules_as_text(rules)) == tuple(rules)


def test_unrelated_columns_are_out_of_reach():
    a = R.Rule(R.IsMobile(), (R.SetAttribute("category", "x"),))
    b = R.Rule(R.AttributeValue("category", "x"), (R.AddTag("t"),))
    c = R.Rule(R.HasTag("u"), (R.Ignore(),))
    assert reached_columns(compare([b, c], [a, b, c])) == {"category", "tags", "ignore"}
    d = R.Rule(R.AttributeValue("hostname", "h"), (R.Ignore(),))
    assert reached_columns(compare([a, b, d], [a, b])) == {"ignore"}


# -- following -------------------------------------------------------------------------------


def follow(place, **options):
    rules = dwelltrace.parse_transform_config({"activeEventRules": RULES, "activeEventMaxDuration": 60}).rules
    return dwelltrace.follow_logs(
        place.spark, str(place.base / "logs"), rules, place.out, checkpoint=str(place.base / "state"), **options
    )


def test_batches_become_versions(place):
    place.log("a.jsonl", window(day(1)), unlock(day(1)))
    place.log("b.jsonl", window(day(1, 1)), window(day(2)))
    follow(place, max_files_per_trigger=1).awaitTermination()
    assert snapshots.latest(place.spark, place.out).version == 2
    assert place.rows() == place.whole()
    for k in range(4):
        place.log(f"c{k}.jsonl", window(day(1, 10 + k)))
    follow(place, max_files_per_trigger=1, most_parts=3).awaitTermination()
    assert place.rows() == place.whole()
    assert len(snapshots.latest(place.spark, place.out).tables["active_events"]["2031-05-01"]) <= 3


def test_a_replayed_batch_adds_nothing(place):
    place.log("a.jsonl", window(day(1)))
    follow(place).awaitTermination()
    for name in ("0", ".0.crc"):
        if os.path.exists(place.base / "state" / "commits" / name):
            os.remove(place.base / "state" / "commits" / name)
    follow(place).awaitTermination()
    assert place.rows() == place.whole()
    assert snapshots.latest(place.spark, place.out).version == 1


def test_tables_are_whole_while_batches_arrive(place):
    for k in range(6):
        place.log(f"{k}.jsonl", *[window(day(1 + k % 3, s)) for s in range(10)], *[unlock(day(1, s)) for s in range(10)])
    query = follow(place, max_files_per_trigger=1)
    seen = set()
    while query.isActive:
        version = snapshots.latest(place.spark, place.out).version
        active, unlocks = (len(rows) for rows in place.rows(version=version)) if version else (0, 0)
        assert active == unlocks == 10 * version
        seen.add(version)
    assert place.rows() == place.whole()


def test_late_hidden_names_end_the_stream(place):
    place.log("a.jsonl", window(day(1)))
    query = follow(place, every_sec=0.2)
    query.processAllAvailable()
    place.log("_late.jsonl", window(day(2)))
    place.log("b.jsonl", window(day(3)))
    with pytest.raises(PySparkException, match="_late"):
        query.processAllAvailable()
    assert not query.isActive
    shutil.move(place.base / "logs" / "_late.jsonl", place.base / "logs" / "late.jsonl")
    follow(place).awaitTermination()
    assert place.rows() == place.whole()


def test_a_streams_folder_is_not_for_runs(place):
    place.log("a.jsonl", window(day(1)))
    follow(place).awaitTermination()
    with pytest.raises(dwelltrace.JobError, match="stream"):
        place.run()
