"""Configuration files: what is accepted, what is refused, and where paths lead."""

import json

import pytest

import dwelltrace
from dwelltrace.operators import rules as R
from dwelltrace.sources.config import load_job_config, parse_recorder_config, parse_transform_config

EXAMPLE = {
    "$schema": "./schemas/any.json",
    "activeEventRules": [
        {
            "predicate": {"attributeRegex": {"name": "processPath", "regex": "^/srv/(render|bake)/"}},
            "actions": [{"setAttribute": {"name": "category", "value": "farm"}}, {"addTag": "batch"}],
        },
        {
            "predicate": {"or": [{"not": {"and": ["isMobile", {"hasTag": "batch"}]}}, {"idleForGreaterThanSec": 45}]},
            "actions": ["ignore"],
        },
        {"predicate": {"hasTag": "pocket"}, "actions": [{"addTag": "away"}], "comment": "unknown keys are ignored"},
    ],
    "activeEventMaxDuration": 240,
}


def test_transform_config():
    config = parse_transform_config(EXAMPLE)
    assert config.max_duration_sec == 240
    assert config.rules == (
        R.Rule(R.AttributeRegex("processPath", "^/srv/(render|bake)/"), (R.SetAttribute("category", "farm"), R.AddTag("batch"))),
        R.Rule(R.Or((R.Not(R.And((R.IsMobile(), R.HasTag("batch")))), R.IdleForGreaterThan(45))), (R.Ignore(),)),
        R.Rule(R.HasTag("pocket"), (R.AddTag("away"),)),
    )


def test_unit_kinds_may_be_objects_with_null():
    assert parse_transform_config({"activeEventRules": [{"predicate": {"isMobile": None}, "actions": [{"ignore": None}]}], "activeEventMaxDuration": 0})


def with_predicate(p):
    return {"activeEventRules": [{"predicate": p, "actions": []}], "activeEventMaxDuration": 1}


def with_action(a):
    return {"activeEventRules": [{"predicate": "isMobile", "actions": [a]}], "activeEventMaxDuration": 1}


@pytest.mark.parametrize(
    "content",
    [
        {}, {"activeEventRules": []}, {"activeEventMaxDuration": 1},
        {"activeEventRules": [], "activeEventMaxDuration": 1.5},
        {"activeEventRules": [], "activeEventMaxDuration": True},
        {"activeEventRules": {}, "activeEventMaxDuration": 1},
        {"activeEventRules": [{"predicate": "isMobile"}], "activeEventMaxDuration": 1},
        with_predicate("unknown"), with_predicate("hasTag"), with_predicate({"hasTag": 1}), with_predicate({}),
        with_predicate({"hasTag": "a", "isMobile": None}), with_predicate({"isMobile": 1}),
        with_predicate({"attributeValue": {"name": "windowTitle", "value": "x"}}),
        with_predicate({"attributeValue": {"name": "tags", "value": "x"}}),
        with_predicate({"attributeValue": {"name": "name"}}),
        with_predicate({"attributeRegex": {"name": "name", "regex": "("}}),
        with_predicate({"attributeRegex": {"name": "name", "regex": "(?=x)"}}),
        with_predicate({"idleForGreaterThanSec": 1.5}), with_predicate({"idleForGreaterThanSec": 2**63}),
        with_predicate({"and": {"hasTag": "x"}}), with_predicate({"not": [{"hasTag": "x"}]}),
        with_action("delete"), with_action("redactProcess"), with_action("addTag"), with_action({"setAttribute": "x"}),
        with_action({"setAttribute": {"name": "isMobile", "value": "x"}}),
    ],
)
def test_bad_transform_configs_are_refused(content):
    with pytest.raises(dwelltrace.ConfigError):
        parse_transform_config(content)


@pytest.mark.parametrize("predicate", ["isMobile", {"idleForGreaterThanSec": 1}, {"attributeValue": {"name": "category", "value": "x"}}])
def test_table_vocabulary_is_refused_in_live_rules(predicate):
    with pytest.raises(dwelltrace.ConfigError):
        parse_recorder_config({"activeWindowEventRules": [{"predicate": predicate, "actions": []}]})


def test_errors_say_where(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(with_predicate({"and": [{"hasTag": "x"}, "oops"]})))
    with pytest.raises(dwelltrace.ConfigError, match=r"rules.json\[0\].predicate.and\[1\].oops"):
        dwelltrace.load_transform_config(str(path))


def test_job_config_from_files(fixture_path):
    config = load_job_config(fixture_path("live", "main_config.json"))
    folder = fixture_path("live")
    assert config.log_directory == folder
    assert (config.log_output_directory, config.output_directory) == (f"{folder}/recorded", f"{folder}/tables")
    assert (config.sample_every_sec, config.write_every_sec, config.output_format) == (12, 90, "parquet")
    assert len(config.recorder.rules) == 4
    assert config.transform.rules == () and config.transform.max_duration_sec == 60


def main_config(**changes):
    content = {
        "logDirectory": "./logs", "logOutputSubdirectory": "here", "sampleEverySec": 15, "writeEverySec": 3600,
        "pipelineOutputDirectory": "../out", "pipelineOutputFormat": "csv",
    }
    return {k: v for k, v in (content | changes).items() if v != "absent"}


def test_paths_are_relative_to_the_configuration(tmp_path):
    (tmp_path / "conf" / "rules").mkdir(parents=True)
    (tmp_path / "conf" / "rules" / "r.json").write_text(json.dumps(EXAMPLE))
    path = tmp_path / "conf" / "main.json"
    path.write_text(json.dumps(main_config(pipelineConfigPath="rules/r.json", logDirectory="hdfs://host/logs")))
    config = load_job_config(str(path))
    assert config.output_directory == str(tmp_path / "out")
    assert config.log_directory == "hdfs://host/logs"
    assert config.log_output_directory == "hdfs://host/logs/here"
    assert len(config.transform.rules) == 3


def test_configuration_through_spark(spark, tmp_path):
    path = tmp_path / "main.json"
    path.write_text(json.dumps(main_config()))
    config = load_job_config(f"file://{path}", spark)
    assert config.log_directory == f"file://{tmp_path}/logs"


@pytest.mark.parametrize(
    "changes", [{"logDirectory": "absent"}, {"pipelineOutputFormat": "xml"}, {"sampleEverySec": 2**31}, {"recorderConfigPath": "missing.json"}]
)
def test_bad_job_configs_are_refused(tmp_path, changes):
    path = tmp_path / "main.json"
    path.write_text(json.dumps(main_config(**changes)))
    with pytest.raises(dwelltrace.ConfigError):
        load_job_config(str(path))
