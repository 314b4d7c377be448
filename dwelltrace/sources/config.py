"""Configuration files: JSON with camelCase keys, read once on the driver.

A predicate or action is an object with one key that names its kind, or a bare string
where the kind takes no value. Unknown kinds, attributes and bad patterns are refused
here, before any data is touched; unknown keys are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from dwelltrace.operators.rules import (
    AddTag,
    And,
    AttributeRegex,
    AttributeValue,
    Delete,
    Dialect,
    HasTag,
    IdleForGreaterThan,
    Ignore,
    IsMobile,
    LIVE_RULES,
    Not,
    Or,
    RedactProcess,
    Rule,
    SetAttribute,
    TABLE_RULES,
)

OUTPUT_FORMATS = ("parquet", "csv")
DEFAULT_MAX_DURATION_SEC = 60


class ConfigError(ValueError):
    """A configuration file that cannot be used, with the place of the fault."""


@dataclass(frozen=True)
class TransformConfig:
    """Rules for the unified table."""

    rules: tuple[Rule, ...] = ()
    max_duration_sec: int = DEFAULT_MAX_DURATION_SEC


@dataclass(frozen=True)
class RecorderConfig:
    """Rules for live events, before they are logged."""

    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class JobConfig:
    """The main configuration with its paths made absolute and its rule files loaded."""

    log_directory: str
    log_output_directory: str
    sample_every_sec: int
    write_every_sec: int
    output_directory: str
    output_format: str
    recorder: RecorderConfig = field(default_factory=RecorderConfig)
    transform: TransformConfig = field(default_factory=TransformConfig)


# -- reading -----------------------------------------------------------------------------


def _is_uri(path: str) -> bool:
    return "://" in path


def _load(path: str, spark: SparkSession | None) -> dict:
    """One JSON object from a driver-local file, or through Spark from any file system it knows."""
    try:
        if _is_uri(path):
            session = spark or SparkSession.active()
            text = session.read.text(path, wholetext=True).first()[0]
        else:
            with open(path, encoding="utf-8") as file:
                text = file.read()
        content = json.loads(text)
    except Exception as error:
        raise ConfigError(f"could not read {path}: {error}") from error
    if not isinstance(content, dict):
        raise ConfigError(f"{path}: expected a JSON object")
    return content


def _require(content: dict, key: str, kind: type, where: str) -> Any:
    if key not in content:
        raise ConfigError(f"{where}: missing key {key!r}")
    return _check(content[key], kind, f"{where}.{key}")


def _check(value: Any, kind: type, where: str) -> Any:
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigError(f"{where}: expected {kind.__name__}, found {value!r}")
    return value


def _integer(content: dict, key: str, bits: int, where: str) -> int:
    value = _require(content, key, int, where)
    if not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1):
        raise ConfigError(f"{where}.{key}: {value} does not fit {bits} bits")
    return value


# -- rules -------------------------------------------------------------------------------


def _variant(value: Any, where: str) -> tuple[str, Any]:
    """Kind and content of an externally tagged value."""
    if isinstance(value, str):
        return value, None
    if isinstance(value, dict) and len(value) == 1:
        return next(iter(value.items()))
    raise ConfigError(f"{where}: expected one kind, found {value!r}")


def _attribute(content: Any, dialect: Dialect, where: str) -> str:
    name = _require(_check(content, dict, where), "name", str, where)
    if name not in dialect.attributes:
        raise ConfigError(f"{where}: unknown attribute {name!r}, expected one of {sorted(dialect.attributes)}")
    return name


def parse_predicate(value: Any, dialect: Dialect, where: str = "predicate"):
    kind, content = _variant(value, where)
    where = f"{where}.{kind}"
    if kind not in dialect.predicates:
        raise ConfigError(f"{where}: unknown predicate, expected one of {sorted(dialect.predicates)}")
    if kind == "attributeValue":
        return AttributeValue(_attribute(content, dialect, where), _require(content, "value", str, where))
    if kind == "attributeRegex":
        try:
            return AttributeRegex(_attribute(content, dialect, where), _require(content, "regex", str, where))
        except ConfigError:
            raise
        except ValueError as error:
            raise ConfigError(f"{where}: {error}") from error
    if kind == "hasTag":
        return HasTag(_check(content, str, where))
    if kind == "idleForGreaterThanSec":
        return IdleForGreaterThan(_integer({kind: content}, kind, 64, where))
    if kind == "not":
        return Not(parse_predicate(content, dialect, where))
    if kind in ("and", "or"):
        parts = _check(content, list, where)
        parsed = tuple(parse_predicate(p, dialect, f"{where}[{i}]") for i, p in enumerate(parts))
        return And(parsed) if kind == "and" else Or(parsed)
    if content is not None:
        raise ConfigError(f"{where}: takes no value")
    return IsMobile()


def parse_action(value: Any, dialect: Dialect, where: str = "action"):
    kind, content = _variant(value, where)
    where = f"{where}.{kind}"
    if kind not in dialect.actions:
        raise ConfigError(f"{where}: unknown action, expected one of {sorted(dialect.actions)}")
    if kind == "addTag":
        return AddTag(_check(content, str, where))
    if kind == "setAttribute":
        return SetAttribute(_attribute(content, dialect, where), _require(content, "value", str, where))
    if content is not None:
        raise ConfigError(f"{where}: takes no value")
    return {"ignore": Ignore, "redactProcess": RedactProcess, "delete": Delete}[kind]()


def parse_rules(values: Any, dialect: Dialect, where: str = "rules") -> tuple[Rule, ...]:
    rules = []
    for i, value in enumerate(_check(values, list, where)):
        here = f"{where}[{i}]"
        _check(value, dict, here)
        predicate = parse_predicate(_require(value, "predicate", object, here), dialect, f"{here}.predicate")
        actions = _require(value, "actions", list, here)
        parsed = (parse_action(a, dialect, f"{here}.actions[{j}]") for j, a in enumerate(actions))
        rules.append(Rule(predicate, tuple(parsed)))
    return tuple(rules)


def _predicate_value(predicate) -> Any:
    match predicate:
        case AttributeValue(name, value):
            return {"attributeValue": {"name": name, "value": value}}
        case AttributeRegex(name, pattern):
            return {"attributeRegex": {"name": name, "regex": pattern}}
        case HasTag(tag):
            return {"hasTag": tag}
        case IdleForGreaterThan(seconds):
            return {"idleForGreaterThanSec": seconds}
        case IsMobile():
            return "isMobile"
        case And(parts):
            return {"and": [_predicate_value(part) for part in parts]}
        case Or(parts):
            return {"or": [_predicate_value(part) for part in parts]}
        case Not(part):
            return {"not": _predicate_value(part)}
    raise TypeError(f"not a predicate: {predicate!r}")


def _action_value(action) -> Any:
    match action:
        case AddTag(tag):
            return {"addTag": tag}
        case SetAttribute(name, value):
            return {"setAttribute": {"name": name, "value": value}}
        case Ignore():
            return "ignore"
        case RedactProcess():
            return "redactProcess"
        case Delete():
            return "delete"
    raise TypeError(f"not an action: {action!r}")


def rules_as_text(rules: Sequence[Rule]) -> str:
    """Rules as a rule file would say them; the same rules always give the same text."""
    values = [
        {"predicate": _predicate_value(rule.predicate), "actions": [_action_value(action) for action in rule.actions]}
        for rule in rules
    ]
    return json.dumps(values, sort_keys=True)


def parse_rules_text(text: str, dialect: Dialect = TABLE_RULES) -> tuple[Rule, ...]:
    """The rules that ``rules_as_text`` has written down."""
    return parse_rules(json.loads(text), dialect)


# -- files -------------------------------------------------------------------------------


def parse_transform_config(content: dict, where: str = "config") -> TransformConfig:
    rules = parse_rules(_require(content, "activeEventRules", list, where), TABLE_RULES, where)
    return TransformConfig(rules, _integer(content, "activeEventMaxDuration", 64, where))


def parse_recorder_config(content: dict, where: str = "config") -> RecorderConfig:
    return RecorderConfig(parse_rules(_require(content, "activeWindowEventRules", list, where), LIVE_RULES, where))


def load_transform_config(path: str, spark: SparkSession | None = None) -> TransformConfig:
    return parse_transform_config(_load(path, spark), path)


def load_recorder_config(path: str, spark: SparkSession | None = None) -> RecorderConfig:
    return parse_recorder_config(_load(path, spark), path)


def load_job_config(path: str, spark: SparkSession | None = None) -> JobConfig:
    """Load the main configuration and the rule files it names.

    Relative paths are relative to the folder of the main file. A rule path that is null or
    absent means no rules.
    """
    content = _load(path, spark)
    folder = path.rpartition("/")[0] if _is_uri(path) else (os.path.dirname(path) or ".")

    def resolve(base: str, relative: str) -> str:
        if _is_uri(relative):
            return relative
        if _is_uri(base):
            return base.rstrip("/") + "/" + relative.removeprefix("./") if relative != "." else base
        return os.path.abspath(os.path.join(base, relative))

    def linked(key: str) -> str | None:
        value = content.get(key)
        return None if value is None else resolve(folder, _check(value, str, f"{path}.{key}"))

    output_format = _require(content, "pipelineOutputFormat", str, path)
    if output_format not in OUTPUT_FORMATS:
        raise ConfigError(f"{path}: unknown output format {output_format!r}, expected one of {OUTPUT_FORMATS}")
    recorder_path, transform_path = linked("recorderConfigPath"), linked("pipelineConfigPath")
    log_directory = resolve(folder, _require(content, "logDirectory", str, path))
    return JobConfig(
        log_directory=log_directory,
        log_output_directory=resolve(log_directory, _require(content, "logOutputSubdirectory", str, path)),
        sample_every_sec=_integer(content, "sampleEverySec", 32, path),
        write_every_sec=_integer(content, "writeEverySec", 32, path),
        output_directory=resolve(folder, _require(content, "pipelineOutputDirectory", str, path)),
        output_format=output_format,
        recorder=load_recorder_config(recorder_path, spark) if recorder_path else RecorderConfig(),
        transform=load_transform_config(transform_path, spark) if transform_path else TransformConfig(),
    )
