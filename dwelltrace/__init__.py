"""Activity-log analytics on Spark: many device logs in, two flat tables out."""

from dwelltrace.operators.live import record, samples_to_events, to_logged, transform_live_events
from dwelltrace.operators.rules import LIVE_RULES, TABLE_RULES, apply_rules, apply_rules_by_value, drop_ignored
from dwelltrace.operators.split import split_long_events
from dwelltrace.operators.unify import active_events_from, unlock_events_from
from dwelltrace.operators.upgrade import upgrade_legacy, upgrade_lines
from dwelltrace.plans.etl import JobError, active_events, run_pipeline, unlock_events, write_outputs
from dwelltrace.plans.incremental import follow_logs, read_active, read_unlocks, run_incremental
from dwelltrace.plans.maintenance import compact_logs
from dwelltrace.plans.workspace import cluster_settings, recommended_settings
from dwelltrace.sinks.snapshots import SnapshotConflict, forget as forget_versions
from dwelltrace.sinks.tables import flatten, write_table
from dwelltrace.sources.config import (
    ConfigError,
    load_job_config,
    load_recorder_config,
    load_transform_config,
    parse_recorder_config,
    parse_transform_config,
)
from dwelltrace.sources.logs import (
    NotALogError,
    read_log_root,
    read_logs,
    read_runtime_events,
    runtime_events_from_text,
    stream_logs,
    stream_runtime_events,
)
from dwelltrace.streaming.batches import flush_and_stop
from dwelltrace.streaming.live_tables import start_live_tables
from dwelltrace.streaming.recorder import start_configured_recorder, start_recorder

__all__ = [
    "ConfigError",
    "JobError",
    "LIVE_RULES",
    "NotALogError",
    "SnapshotConflict",
    "TABLE_RULES",
    "active_events",
    "active_events_from",
    "apply_rules",
    "apply_rules_by_value",
    "cluster_settings",
    "compact_logs",
    "drop_ignored",
    "flatten",
    "flush_and_stop",
    "follow_logs",
    "forget_versions",
    "load_job_config",
    "load_recorder_config",
    "load_transform_config",
    "parse_recorder_config",
    "parse_transform_config",
    "read_active",
    "read_log_root",
    "read_logs",
    "read_runtime_events",
    "read_unlocks",
    "recommended_settings",
    "record",
    "run_incremental",
    "run_pipeline",
    "runtime_events_from_text",
    "samples_to_events",
    "split_long_events",
    "start_configured_recorder",
    "start_live_tables",
    "start_recorder",
    "stream_logs",
    "stream_runtime_events",
    "to_logged",
    "transform_live_events",
    "unlock_events",
    "unlock_events_from",
    "upgrade_legacy",
    "upgrade_lines",
    "write_outputs",
    "write_table",
]
