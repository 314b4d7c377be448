"""The same answers in plain SQL, straight from the ``events`` table."""

from __future__ import annotations

# Column list of the unified table as the queries return it.
ACTIVE_COLUMNS = (
    'time, duration_ms, hostname, username, idle_ms, "processName", "processPath", "applicationLabel", '
    '"applicationId", name, category, "ignore", "isMobile", array_to_string(tags, \'|\') AS tags'
)

_BASE = r"""
b AS (
  SELECT event_id, ts, value, event_type,
    CASE WHEN event_id % 10 = 0 THEN 'ActiveWindowEvent'
         WHEN event_id % 10 <= 5 THEN 'ActiveWindowEventV1'
         WHEN event_id % 10 <= 7 THEN 'ActiveActivityEventV1'
         WHEN event_id % 10 = 8 THEN 'DeviceUnlockEventV1'
         ELSE 'UnknownEventV9' END AS type,
    event_id % 10 <= 5 AS desktop,
    concat('host', user_id % 7) AS hostname,
    concat('user', user_id) AS username,
    (event_id * 37) % 600 AS idle,
    CASE event_id % 4 WHEN 0 THEN concat('C:\Program Files\App\', event_type, '.EXE')
                      WHEN 1 THEN concat('/usr/bin/', event_type, '.sh')
                      WHEN 2 THEN concat('/opt/', event_type, '/') END AS path,
    CASE event_id % 3 WHEN 0 THEN ['browser'] WHEN 1 THEN CAST([] AS VARCHAR[]) ELSE [event_type] END AS tags,
    concat(event_type, CASE WHEN user_id % 2 = 0 THEN ' | draft' ELSE ' drafts page' END) AS title
  FROM events
)"""
_ACTIVE = r""",
n AS (
  SELECT *, regexp_replace(nullif(regexp_extract(path, '([^\\/]+)$', 1), ''),
                           '\.(exe|bat|ps1|com|sh|bin)$', '', 'i') AS program
  FROM b WHERE type IN ('ActiveWindowEvent', 'ActiveWindowEventV1', 'ActiveActivityEventV1')
),
a AS (
  SELECT event_id, ts AS time, CAST(trunc(value * 1000.0) AS BIGINT) AS duration_ms, hostname,
    CASE WHEN desktop THEN username END AS username,
    CASE WHEN desktop THEN idle * 1000 END AS idle_ms,
    CASE WHEN desktop THEN program END AS "processName",
    CASE WHEN desktop THEN path END AS "processPath",
    CASE WHEN NOT desktop THEN upper(event_type) END AS "applicationLabel",
    CASE WHEN NOT desktop THEN concat('org.example.', event_type) END AS "applicationId",
    lower(CASE WHEN desktop THEN program ELSE upper(event_type) END) AS name,
    CAST(NULL AS VARCHAR) AS category, false AS "ignore", NOT desktop AS "isMobile",
    CASE WHEN desktop THEN tags ELSE CAST([] AS VARCHAR[]) END AS tags
  FROM n
)"""
_LIVE = r""",
s AS (SELECT *, nullif(regexp_extract(path, '([^\\/]+)[\\/]*$', 1), '') AS component FROM b),
r AS (
  SELECT ts AS time, CAST(round(value) AS BIGINT) AS duration_s, hostname, username, idle AS idle_s,
    path AS "processPath", regexp_replace(component, '(.)\.[^.]*$', '\1') AS "processName",
    tags, title AS "windowTitle"
  FROM s
)"""
LIVE_COLUMNS = (
    "'ActiveWindowEventV1' AS type, time, duration_s, hostname, username, idle_s, \"processPath\", "
    "array_to_string(tags, '|') AS tags"
)


def from_events(select: str) -> str:
    return f"WITH {_BASE}\n{select}"


def from_active(select: str, *steps: str) -> str:
    """A query over the unified table ``a`` and, one per step, the tables ``t1``, ``t2``, …"""
    return f"WITH {_BASE}{_ACTIVE}{_chain('a', steps)}\n{select}"


def from_live(select: str, *steps: str) -> str:
    """The same over live events ``r``."""
    return f"WITH {_BASE}{_LIVE}{_chain('r', steps)}\n{select}"


def _chain(start: str, steps: tuple[str, ...]) -> str:
    names = [start, *(f"t{i}" for i in range(1, len(steps) + 1))]
    return "".join(f",\n{name} AS ({step.format(prev=prev)})" for prev, name, step in zip(names, names[1:], steps))


def rule(predicate: str, *changes: str) -> str:
    """One rule as a query over ``{prev}``; the predicate is judged before any change."""
    replaced = ", ".join(f"CASE WHEN fires THEN {value} ELSE {column} END AS {column}" for value, column in map(_split, changes))
    return f"SELECT * EXCLUDE (fires) REPLACE ({replaced}) FROM (SELECT *, ({predicate}) AS fires FROM {{prev}})"


def _split(change: str) -> tuple[str, str]:
    value, _, column = change.rpartition(" AS ")
    return value, column


def add_tags(*tags: str) -> str:
    """Append each tag that is not there yet."""
    value = "tags"
    for tag in tags:
        value = f"(CASE WHEN list_contains({value}, '{tag}') THEN {value} ELSE list_append({value}, '{tag}') END)"
    return f"{value} AS tags"


def delete(predicate: str) -> str:
    return f"SELECT * FROM {{prev}} WHERE NOT coalesce({predicate}, false)"


def three_valued(predicate: str, name: str) -> str:
    """A condition as text, so that null is told apart from false."""
    return f"CASE WHEN ({predicate}) IS NULL THEN 'null' WHEN ({predicate}) THEN 'true' ELSE 'false' END AS {name}"
