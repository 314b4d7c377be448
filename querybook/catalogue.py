"""Every registered query with its SQL counterpart beside it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import dwelltrace as dt
from dwelltrace.files import remove
from dwelltrace.functions import durations, paths, regex, tags
from dwelltrace.operators.live import flat_live_events
from dwelltrace.operators.rules import LIVE_RULES, TABLE_RULES, predicate_column
from dwelltrace.plans.workspace import recommended_settings, shared_folder
from dwelltrace.schemas import ACTIVE_SCHEMA, LOGGED_SCHEMA, UNLOCK_EVENT, UNLOCK_LOG_SCHEMA
from dwelltrace.sinks.lines import event_lines, write_lines
from dwelltrace.sources.config import JobConfig, RecorderConfig, TransformConfig, parse_predicate
from querybook import oracle as sql
from querybook.derive import events, log_line, log_root, samples, write_wave

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(oracle: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in recommended_settings().items():
                spark.conf.set(key, value)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = tuned
        ORACLE[query.__name__] = oracle
        return query

    return add


# -- shaping results so that both engines can print them ----------------------------------


def flat(df: DataFrame) -> DataFrame:
    """The unified table with durations in milliseconds and tags joined."""
    return df.select(
        *[
            durations.duration_to_millis(F.col(c)).alias({"duration": "duration_ms", "idleFor": "idle_ms"}[c])
            if c in ("duration", "idleFor")
            else (tags.join_list(F.col(c)).alias(c) if c == "tags" else F.col(c))
            for c in ACTIVE_SCHEMA.fieldNames()
        ]
    )


def flat_logged(logged: DataFrame) -> DataFrame:
    return logged.select(
        "type",
        "time",
        F.col("data.duration").cast("bigint").alias("duration_s"),
        "data.hostname",
        "data.username",
        F.col("data.idleFor").cast("bigint").alias("idle_s"),
        "data.processPath",
        tags.join_list(F.col("data.tags")).alias("tags"),
    )


def three_valued(condition: Column, name: str) -> Column:
    return F.coalesce(condition.cast("string"), F.lit("null")).alias(name)


def active(spark: SparkSession, sf_dir: str, rules=()) -> DataFrame:
    return dt.active_events(spark, log_root(spark, sf_dir) + "/devices/*", rules)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.read_runtime_events(spark, log_root(spark, sf_dir, "live"))


def table_rules(*rules: dict):
    return dt.parse_transform_config({"activeEventRules": list(rules), "activeEventMaxDuration": 60}).rules


def live_rules(*rules: dict):
    return dt.parse_recorder_config({"activeWindowEventRules": list(rules)}).rules


def when(predicate, *actions) -> dict:
    return {"predicate": predicate, "actions": list(actions)}


def pattern(name: str, text: str) -> dict:
    return {"attributeRegex": {"name": name, "regex": text}}


def value(name: str, text: str) -> dict:
    return {"attributeValue": {"name": name, "value": text}}


def setting(name: str, text: str) -> dict:
    return {"setAttribute": {"name": name, "value": text}}


ALL_ACTIVE = sql.from_active(f"SELECT {sql.ACTIVE_COLUMNS} FROM a")
UNLOCKS = sql.from_events("SELECT ts AS time, hostname FROM b WHERE type = 'DeviceUnlockEventV1'")


# -- scans and unification ----------------------------------------------------------------


@register(ALL_ACTIVE)
def active_events_unified(spark, sf_dir):
    return flat(active(spark, sf_dir))


@register(UNLOCKS)
def unlock_events(spark, sf_dir):
    return dt.unlock_events(spark, log_root(spark, sf_dir) + "/devices/*")


@register(
    sql.from_events(
        """SELECT ts AS time, hostname, CASE type WHEN 'DeviceUnlockEventV1' THEN 'unlock'
             WHEN 'ActiveActivityEventV1' THEN 'mobile' ELSE 'desktop' END AS kind
           FROM b WHERE type <> 'UnknownEventV9'"""
    )
)
def type_discriminator_drop_unknown(spark, sf_dir):
    logs = dt.read_log_root(spark, log_root(spark, sf_dir))
    kind = F.when(F.col("isMobile"), "mobile").otherwise("desktop").alias("kind")
    used = dt.active_events_from(logs).select("time", "hostname", kind)
    return used.unionAll(dt.unlock_events_from(logs).select("time", "hostname", F.lit("unlock").alias("kind")))


@register(ALL_ACTIVE)
def gzip_and_plain_union(spark, sf_dir):
    return flat(dt.active_events_from(dt.read_log_root(spark, log_root(spark, sf_dir, "mixed"))))


@register(UNLOCKS)
def gzip_and_plain_unlocks(spark, sf_dir):
    logs = dt.read_log_root(
        spark, log_root(spark, sf_dir, "mixed"), schema=UNLOCK_LOG_SCHEMA, types=[UNLOCK_EVENT], on_corrupt="drop"
    )
    return dt.unlock_events_from(logs)


@register(
    sql.from_active(
        f"SELECT {sql.ACTIVE_COLUMNS} FROM "
        "(SELECT * REPLACE (CASE WHEN event_id % 50 <> 7 THEN duration_ms END AS duration_ms) FROM a)"
    )
)
def corrupt_lines_tolerated(spark, sf_dir):
    logs = dt.read_log_root(spark, log_root(spark, sf_dir, "damaged"), on_corrupt="file")
    return flat(dt.active_events_from(logs))


@register(sql.from_active('SELECT time, "isMobile", hostname FROM a'))
def timestamp_variants(spark, sf_dir):
    return active(spark, sf_dir).select("time", "isMobile", "hostname")


@register(
    sql.from_live(
        'SELECT time, "windowTitle", hostname, username, "processPath", idle_s, '
        "array_to_string(tags, '|') AS tags FROM r"
    )
)
def runtime_event_scan(spark, sf_dir):
    return live(spark, sf_dir).select(
        "time",
        "windowTitle",
        "data.hostname",
        "data.username",
        "data.processPath",
        F.col("data.idleFor").cast("bigint").alias("idle_s"),
        tags.join_list(F.col("data.tags")).alias("tags"),
    )


@register(sql.from_live('SELECT time, "windowTitle", "processPath" FROM r'))
def runtime_events_from_queue_text(spark, sf_dir):
    lines = spark.read.text(log_root(spark, sf_dir, "live"))
    return dt.runtime_events_from_text(lines).select("time", "windowTitle", "data.processPath")


@register(ALL_ACTIVE)
def torn_lines_any_cut(spark, sf_dir):
    logs = dt.read_log_root(spark, log_root(spark, sf_dir, "torn"), on_corrupt="drop")
    return flat(dt.active_events_from(logs))


@register(UNLOCKS)
def torn_lines_any_cut_unlocks(spark, sf_dir):
    logs = dt.read_log_root(
        spark, log_root(spark, sf_dir, "torn"), schema=UNLOCK_LOG_SCHEMA, types=[UNLOCK_EVENT], on_corrupt="drop"
    )
    return dt.unlock_events_from(logs)


@register(sql.from_events("SELECT ts AS time, hostname, true AS refused FROM b WHERE type = 'DeviceUnlockEventV1'"))
def hidden_logs_refused(spark, sf_dir):
    """Reading the root fails and names the folder; read by parts, nothing is lost."""
    root = log_root(spark, sf_dir, "hidden")
    try:
        dt.read_log_root(spark, root)
        refused = False
    except dt.NotALogError as error:
        refused = "_old" in str(error)
    parts = [dt.unlock_events(spark, f"{root}/{part}/*") for part in ("open", "_old/2024")]
    return parts[0].unionAll(parts[1]).withColumn("refused", F.lit(refused))


@register(sql.from_live('SELECT time, "windowTitle", true AS refused FROM r'))
def hidden_live_events_refused(spark, sf_dir):
    """Half of the live events lie under a hidden name: no reader passes over them."""
    folder = shared_folder(spark, "hidden-live")
    lines = spark.read.text(log_root(spark, sf_dir, "live"))
    even = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    write_lines(lines.filter(even), f"{folder}/open")
    write_lines(lines.filter(~even), f"{folder}/_later")
    refused = []
    for read in (dt.read_runtime_events, dt.stream_runtime_events):
        try:
            read(spark, folder)
        except dt.NotALogError as error:
            refused.append("_later" in str(error))
    parts = [dt.read_runtime_events(spark, f"{folder}/{part}/*") for part in ("open", "_later")]
    whole = parts[0].unionAll(parts[1]).select("time", "windowTitle")
    return whole.withColumn("refused", F.lit(refused == [True, True]))


@register(sql.from_events("SELECT ts AS time, hostname, true AS refused FROM b WHERE type = 'DeviceUnlockEventV1'"))
def hidden_logs_refused_in_stream(spark, sf_dir):
    """Logs come under a hidden name while a stream runs: the stream ends, and goes on where it was
    once they have another name."""
    root, folder, state = (shared_folder(spark, name) for name in ("late-logs", "late-tables", "late-state"))
    write_wave(spark, sf_dir, 0, f"{root}/first")

    def follow(every_sec=None):
        outputs = f"{folder}/active", f"{folder}/unlock"
        return dt.start_live_tables(spark, root, (), *outputs, checkpoint=state, every_sec=every_sec)

    query = follow(every_sec=0.5)
    query.processAllAvailable()
    write_wave(spark, sf_dir, 1, f"{root}/_second")
    write_wave(spark, sf_dir, 1, f"{root}/second/part")
    try:
        query.processAllAvailable()
        refused = False
    except PySparkException as error:
        refused = "_second" in str(error)
    remove(spark, f"{root}/_second")
    follow().awaitTermination()
    unlocks = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/unlock")
    return unlocks.withColumn("refused", F.lit(refused))


# -- scalar functions ---------------------------------------------------------------------


@register(
    sql.from_active(
        """SELECT time, duration_ms, duration_ms // 1000 AS duration_s,
           CASE WHEN idle_ms IS NULL THEN 'null' WHEN idle_ms > 120000 THEN 'true' ELSE 'false' END AS idle_long
           FROM a"""
    )
)
def duration_truncation(spark, sf_dir):
    df = active(spark, sf_dir)
    return df.select(
        "time",
        durations.duration_to_millis(F.col("duration")).alias("duration_ms"),
        durations.duration_to_seconds(F.col("duration")).alias("duration_s"),
        three_valued(durations.longer_than(F.col("idleFor"), 120), "idle_long"),
    )


@register(sql.from_events("SELECT event_id, CAST(round(value) AS BIGINT) AS rounded, CAST(round(-value) AS BIGINT) AS negated FROM b"))
def duration_rounding(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select(
        "event_id",
        durations.round_to_seconds(F.col("value")).alias("rounded"),
        durations.round_to_seconds(-F.col("value")).alias("negated"),
    )


@register(sql.from_active('SELECT time, "processPath", "processName", name FROM a'))
def process_name_unified(spark, sf_dir):
    return active(spark, sf_dir).select("time", "processPath", "processName", "name")


@register(sql.from_live('SELECT time, "processPath", "processName" FROM r'))
def process_name_recorder(spark, sf_dir):
    return flat_live_events(live(spark, sf_dir)).select("time", "processPath", "processName")


@register(
    sql.from_active(
        """SELECT time, list_contains(tags, 'browser') AS has_browser,
           array_to_string(list_append(tags, 'x'), '|') AS appended, array_to_string(tags, '|') AS joined FROM a"""
    )
)
def tag_list_functions(spark, sf_dir):
    df = active(spark, sf_dir, table_rules(when({"and": []}, {"addTag": "x"})))
    return df.select(
        "time",
        tags.has_tag(F.col("tags"), "browser").alias("has_browser"),
        tags.join_list(F.col("tags")).alias("appended"),
        # The rule above appended one tag to every row; without it the list is as read.
        tags.join_list(F.slice("tags", 1, F.size("tags") - 1)).alias("joined"),
    )


_DIALECT_PATTERNS = {
    "anchored": r"^/usr/",
    "at_end": r"\.EXE$",
    "ignoring_case": r"(?i)\.exe$",
    "named_group": r"(?P<kind>click|view)\.",
    "negated_class": r"[\\/][^\\/]*e[^\\/]*[\\/]?$",
    "posix_class": r"[[:upper:]]:",
    "counted": r"[aeiou]{2}",
    "lazy": r"/.+?/",
    "scoped_flags": r"(?i:PROGRAM) Files",
    "optional_group": r"bin/(?:s(?:ign)?|v)",
}


@register(
    sql.from_active(
        'SELECT time, "processPath", '
        + ", ".join(sql.three_valued(f"regexp_matches(\"processPath\", '{p}')", n) for n, p in _DIALECT_PATTERNS.items())
        + " FROM a"
    )
)
def regex_dialect(spark, sf_dir):
    path = F.col("processPath")
    found = [three_valued(regex.search(path, p), n) for n, p in _DIALECT_PATTERNS.items()]
    return active(spark, sf_dir).select("time", path, *found)


_LONG_PATTERNS = {
    "letters_then_other": r"(?:a|e|i|o|u|[^aeiou])*\u00ff",
    "told_apart": r"(?:/u|\\P|[a-z]{2})+\u00e9$",
    "ending": r"(?:é|x)+$",
    "accented": r"[à-ï]{1}\z",
    "overlapping": r"/(u|us|[^é])*é$",
    "any_case": r"\.(?i)(SH|S|H|[^é])*é",
    "nested": r"^(?:/?(?:\w|\w\w|[.-])+)+é\z",
}
_LONG_SQL = {
    "letters_then_other": "contains(v, 'ÿ')",
    "told_apart": "regexp_matches(v, '(?:/u|\\\\P|[a-z]{2})+é$')",
    "ending": "ends_with(v, 'é')",
    "accented": "ends_with(v, 'é')",
    "overlapping": "contains(v, '/')",
    "any_case": "contains(v, '.')",
    "nested": "NOT regexp_matches(v, '[^/\\w.é-]|//')",
}


@register(
    sql.from_active(
        "SELECT time, hostname, "
        + ", ".join(sql.three_valued(condition, name) for name, condition in _LONG_SQL.items())
        + " FROM (SELECT *, repeat(coalesce(\"processPath\", name), 1000) || 'é' AS v FROM a)"
    )
)
def regex_on_long_values(spark, sf_dir):
    rows = active(spark, sf_dir).withColumn("short", F.coalesce("processPath", "name"))
    # A value is made and searched once, however many rows have it. The shuffle behind the searches
    # keeps them out of the join, which would repeat them for every row.
    values = rows.select("short").distinct().withColumn("v", F.concat(F.repeat("short", F.lit(1000)), F.lit("é")))
    found = [three_valued(regex.search(F.col("v"), p), n) for n, p in _LONG_PATTERNS.items()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = values.select(F.col("short").alias("searched"), *found).repartition(tasks)
    return rows.join(values, F.col("short").eqNullSafe(F.col("searched"))).select("time", "hostname", *_LONG_PATTERNS)


# -- rules over the unified table ---------------------------------------------------------


def _predicate(name: str, rule: dict | str, condition: str) -> None:
    """Register a query that shows one predicate per row, nulls told apart."""

    def query(spark, sf_dir):
        column = predicate_column(parse_predicate(rule, TABLE_RULES), TABLE_RULES)
        return active(spark, sf_dir).select("time", "hostname", "name", three_valued(column, "fires"))

    query.__name__ = name
    register(sql.from_active(f"SELECT time, hostname, name, {sql.three_valued(condition, 'fires')} FROM a"))(query)


_predicate("pred_attribute_value", value("processName", "click"), "coalesce(\"processName\" = 'click', false)")
_predicate("pred_attribute_regex", pattern("processPath", r"[\\/](App|opt)[\\/]"), r"""regexp_matches("processPath", '[\\/](App|opt)[\\/]')""")
_predicate("pred_attribute_word", pattern("name", "view"), "contains(name, 'view')")
_predicate("pred_has_tag", {"hasTag": "browser"}, "list_contains(tags, 'browser')")
_predicate("pred_is_mobile", "isMobile", '"isMobile"')
_predicate("pred_idle_gt", {"idleForGreaterThanSec": 300}, "idle_ms > 300000")
_predicate(
    "pred_and",
    {"and": [{"idleForGreaterThanSec": 100}, {"hasTag": "browser"}, pattern("name", "c|v")]},
    "idle_ms > 100000 AND list_contains(tags, 'browser') AND regexp_matches(name, 'c|v')",
)
_predicate(
    "pred_or",
    {"or": [{"idleForGreaterThanSec": 500}, "isMobile", value("username", "user5")]},
    "idle_ms > 500000 OR \"isMobile\" OR coalesce(username = 'user5', false)",
)
_predicate("pred_and_empty", {"and": []}, "true")
_predicate("pred_or_empty", {"or": []}, "false")
_predicate(
    "pred_not_null_logic",
    {"not": {"or": [pattern("processPath", "bin"), {"idleForGreaterThanSec": 400}]}},
    "NOT (regexp_matches(\"processPath\", 'bin') OR idle_ms > 400000)",
)
_predicate("pred_not_value_on_null", {"not": value("processName", "click")}, "NOT coalesce(\"processName\" = 'click', false)")


def _rules(name: str, rules: list[dict], steps: list[str], drop_ignored: bool = False) -> None:
    """Register a query that runs a rule list, with one SQL step per rule."""

    def query(spark, sf_dir):
        out = active(spark, sf_dir, table_rules(*rules))
        return flat(dt.drop_ignored(out) if drop_ignored else out)

    query.__name__ = name
    where = ' WHERE NOT "ignore"' if drop_ignored else ""
    register(sql.from_active(f"SELECT {sql.ACTIVE_COLUMNS} FROM t{len(steps)}{where}", *steps))(query)


_rules(
    "action_add_tag",
    [when({"hasTag": "browser"}, {"addTag": "web"}), when(pattern("name", "click"), {"addTag": "browser"})],
    [
        sql.rule("list_contains(tags, 'browser')", sql.add_tags("web")),
        sql.rule("regexp_matches(name, 'click')", sql.add_tags("browser")),
    ],
)
_rules(
    "action_set_attribute",
    [
        when(pattern("name", "purchase|signup"), setting("category", "account")),
        when("isMobile", setting("category", "phone"), setting("username", "nobody")),
        when(value("processName", "view"), setting("processPath", "/hidden")),
    ],
    [
        sql.rule("regexp_matches(name, 'purchase|signup')", "'account' AS category"),
        sql.rule('"isMobile"', "'phone' AS category", "'nobody' AS username"),
        sql.rule("\"processName\" = 'view'", "'/hidden' AS \"processPath\""),
    ],
)
_rules(
    "rules_over_labels",
    [
        when(value("applicationLabel", "CLICK"), setting("applicationLabel", "Tap"), setting("category", "touch")),
        when(pattern("applicationId", r"\.(view|error)$"), {"addTag": "seen"}),
        when({"not": pattern("applicationLabel", "[A-Z][A-Z]")}, setting("applicationId", "none")),
    ],
    [
        sql.rule("coalesce(\"applicationLabel\" = 'CLICK', false)", "'Tap' AS \"applicationLabel\"", "'touch' AS category"),
        sql.rule("regexp_matches(\"applicationId\", '\\.(view|error)$')", sql.add_tags("seen")),
        sql.rule("NOT regexp_matches(\"applicationLabel\", '[A-Z][A-Z]')", "'none' AS \"applicationId\""),
    ],
)
_rules(
    "action_ignore",
    [when({"idleForGreaterThanSec": 300}, "ignore")],
    [sql.rule("idle_ms > 300000", 'true AS "ignore"')],
)
_rules(
    "drop_ignored",
    [when({"idleForGreaterThanSec": 300}, "ignore")],
    [sql.rule("idle_ms > 300000", 'true AS "ignore"')],
    drop_ignored=True,
)
_rules(
    "rule_simultaneous_actions",
    [
        when(value("name", "click"), setting("name", "tap"), {"addTag": "first"}, {"addTag": "second"}, setting("category", "c")),
        when(value("name", "tap"), setting("category", "touch"), setting("name", "click")),
    ],
    [
        sql.rule("name = 'click'", "'tap' AS name", sql.add_tags("first", "second"), "'c' AS category"),
        sql.rule("name = 'tap'", "'touch' AS category", "'click' AS name"),
    ],
)

CHAIN = [
    when(pattern("name", "click|view"), {"addTag": "ui"}, setting("category", "interaction")),
    when(
        {"and": [{"idleForGreaterThanSec": 300}, {"not": {"or": [{"hasTag": "ui"}, {"hasTag": "browser"}]}}]},
        "ignore",
    ),
    when(pattern("processPath", r"[\\/](App|opt)[\\/]"), setting("category", "apps")),
    when("isMobile", {"addTag": "mobile"}),
    when({"hasTag": "mobile"}, setting("category", "phone")),
    when(value("category", "phone"), {"addTag": "phone-time"}, setting("name", "a phone")),
    when({"not": pattern("processPath", "bin")}, {"addTag": "no-bin"}),
    when(pattern("name", "phone$"), {"addTag": "ui"}),
    when({"and": [{"hasTag": "ui"}, {"hasTag": "no-bin"}]}, setting("hostname", "merged")),
    when({"or": [value("hostname", "merged"), {"idleForGreaterThanSec": 590}]}, {"addTag": "last"}, "ignore"),
]
CHAIN_STEPS = [
    sql.rule("regexp_matches(name, 'click|view')", sql.add_tags("ui"), "'interaction' AS category"),
    sql.rule("idle_ms > 300000 AND NOT (list_contains(tags, 'ui') OR list_contains(tags, 'browser'))", 'true AS "ignore"'),
    sql.rule(r"""regexp_matches("processPath", '[\\/](App|opt)[\\/]')""", "'apps' AS category"),
    sql.rule('"isMobile"', sql.add_tags("mobile")),
    sql.rule("list_contains(tags, 'mobile')", "'phone' AS category"),
    sql.rule("category = 'phone'", sql.add_tags("phone-time"), "'a phone' AS name"),
    sql.rule("NOT regexp_matches(\"processPath\", 'bin')", sql.add_tags("no-bin")),
    sql.rule("regexp_matches(name, 'phone$')", sql.add_tags("ui")),
    sql.rule("list_contains(tags, 'ui') AND list_contains(tags, 'no-bin')", "'merged' AS hostname"),
    sql.rule("hostname = 'merged' OR idle_ms > 590000", sql.add_tags("last"), 'true AS "ignore"'),
]
_rules("rule_chain", CHAIN, CHAIN_STEPS)
RULED_ACTIVE = sql.from_active(f"SELECT {sql.ACTIVE_COLUMNS} FROM t{len(CHAIN_STEPS)}", *CHAIN_STEPS)


# So many patterns that they are tried once per value; those of the chain come last.
_MANY = [when(pattern(name, f"no such {name} {k}"), {"addTag": f"none{k}"}) for k in range(40) for name in ("name", "processPath")]


@register(RULED_ACTIVE)
def rules_by_value(spark, sf_dir):
    """The chain after many rules that never fire, patterns tried once per distinct value."""
    return flat(dt.apply_rules_by_value(active(spark, sf_dir), table_rules(*_MANY, *CHAIN)))


# -- sinks --------------------------------------------------------------------------------


@register(
    sql.from_active(
        """SELECT strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS time, CAST(duration_ms // 1000 AS VARCHAR) AS duration,
           hostname, username, CAST(idle_ms // 1000 AS VARCHAR) AS "idleFor", "processName", "processPath",
           "applicationLabel", "applicationId", name, category, CAST("ignore" AS VARCHAR) AS "ignore",
           CAST("isMobile" AS VARCHAR) AS "isMobile", nullif(array_to_string(tags, '|'), '') AS tags FROM t1""",
        sql.rule("list_contains(tags, 'browser')", sql.add_tags("web")),
    )
)
def csv_flatten(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    rules = table_rules(when({"hasTag": "browser"}, {"addTag": "web"}))
    dt.write_table(active(spark, sf_dir, rules), folder, "csv")
    text = ", ".join(f"{name} string" for name in ACTIVE_SCHEMA.fieldNames())
    # Spark's CSV reader takes both nothing and "" for null.
    return spark.read.schema(text).options(header=True, escape='"').csv(folder)


@register(ALL_ACTIVE)
def parquet_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "parquet")
    dt.write_table(active(spark, sf_dir), folder, "parquet")
    return flat(spark.read.parquet(folder))


@register(
    sql.from_events(
        """SELECT CASE type WHEN 'DeviceUnlockEventV1' THEN 'unlock' ELSE 'active' END AS output, hostname, count(*) AS n
           FROM b WHERE type <> 'UnknownEventV9' GROUP BY ALL"""
    )
)
def both_outputs_written(spark, sf_dir):
    outputs = dt.write_outputs(
        active(spark, sf_dir), unlock_events(spark, sf_dir), shared_folder(spark, "outputs"), "parquet"
    )
    tables = {"active": outputs.active_events, "unlock": outputs.unlock_events}
    rows = [spark.read.parquet(p).select(F.lit(n).alias("output"), "hostname") for n, p in tables.items()]
    return rows[0].unionAll(rows[1]).groupBy("output", "hostname").agg(F.count(F.lit(1)).alias("n"))


# -- live events --------------------------------------------------------------------------


def _live_predicate(name: str, rule: dict, condition: str) -> None:
    def query(spark, sf_dir):
        rows = flat_live_events(live(spark, sf_dir))
        column = predicate_column(parse_predicate(rule, LIVE_RULES), LIVE_RULES)
        return rows.select("time", "hostname", "processName", three_valued(column, "fires"))

    query.__name__ = name
    register(sql.from_live(f'SELECT time, hostname, "processName", {sql.three_valued(condition, "fires")} FROM r'))(query)


_live_predicate(
    "recorder_predicates",
    {"and": [{"or": [value("processName", "click"), pattern("windowTitle", r"\| draft$")]}, {"not": {"hasTag": "browser"}}]},
    """(coalesce("processName" = 'click', false) OR coalesce(regexp_matches("windowTitle", '\\| draft$'), false))
       AND NOT list_contains(tags, 'browser')""",
)
_live_predicate(
    "recorder_not_null_logic",
    {"not": pattern("processPath", "bin|opt")},
    "NOT coalesce(regexp_matches(\"processPath\", 'bin|opt'), false)",
)

LIVE_CHAIN = [
    when(pattern("windowTitle", r"\| draft$"), {"addTag": "draft"}),
    when({"or": [{"and": [{"hasTag": "draft"}, value("username", "user7")]}, pattern("username", "[13]$")]}, {"addTag": "team"}),
    when(value("processName", "purchase"), "redactProcess", {"addTag": "private"}),
    when({"not": pattern("processPath", ".")}, {"addTag": "pathless"}),
    when(value("processName", "signup"), {"addTag": "gone"}, "delete", {"addTag": "never"}),
    when({"and": [{"hasTag": "private"}, value("hostname", "host3")]}, "delete"),
    when({"hasTag": "gone"}, {"addTag": "impossible"}),
]


def _found(column: str, text: str) -> str:
    return f"coalesce(regexp_matches(\"{column}\", '{text}'), false)"


_REDACTION = ('NULL AS "processPath"', 'NULL AS "processName"')
LIVE_STEPS = [
    sql.rule(_found("windowTitle", r"\| draft$"), sql.add_tags("draft")),
    sql.rule(
        f"(list_contains(tags, 'draft') AND coalesce(username = 'user7', false)) OR {_found('username', '[13]$')}",
        sql.add_tags("team"),
    ),
    sql.rule("coalesce(\"processName\" = 'purchase', false)", *_REDACTION, sql.add_tags("private")),
    sql.rule(f"NOT {_found('processPath', '.')}", sql.add_tags("pathless")),
    sql.delete("\"processName\" = 'signup'"),
    sql.delete("list_contains(tags, 'private') AND hostname = 'host3'"),
    sql.rule("list_contains(tags, 'gone')", sql.add_tags("impossible")),
]


def _live_rules(name: str, rules: list[dict], steps: list[str]) -> None:
    def query(spark, sf_dir):
        return flat_logged(dt.record(live(spark, sf_dir), live_rules(*rules)))

    query.__name__ = name
    register(sql.from_live(f"SELECT {sql.LIVE_COLUMNS} FROM t{len(steps)}", *steps))(query)


_live_rules("recorder_add_tag", LIVE_CHAIN[:2], LIVE_STEPS[:2])
_live_rules("recorder_redact", LIVE_CHAIN[2:4], LIVE_STEPS[2:4])
_live_rules("recorder_delete", LIVE_CHAIN[4:5], LIVE_STEPS[4:5])
_live_rules("recorder_chain", LIVE_CHAIN, LIVE_STEPS)
RECORDED = ORACLE["recorder_chain"]


@register(
    sql.from_live('SELECT time, "windowTitle", array_to_string(tags, \'|\') AS tags FROM t2', *LIVE_STEPS[:2])
)
def recorder_keeps_title_until_logged(spark, sf_dir):
    out = dt.transform_live_events(live(spark, sf_dir), live_rules(*LIVE_CHAIN[:2]))
    return out.select("time", "windowTitle", tags.join_list(F.col("data.tags")).alias("tags"))


@register(RECORDED)
def event_log_sink(spark, sf_dir):
    folder = shared_folder(spark, "event-log")
    write_lines(event_lines(dt.record(live(spark, sf_dir), live_rules(*LIVE_CHAIN))), folder)
    return flat_logged(dt.read_log_root(spark, folder))


@register(
    sql.from_events(
        """SELECT ts AS time, 15 AS duration_s, hostname, username, CAST(round(value) AS BIGINT) AS idle_s,
           path AS "processPath", '' AS tags, CASE WHEN event_id % 5 <> 0 THEN title ELSE '' END AS "windowTitle"
           FROM b WHERE event_type NOT IN ('signup', 'error')"""
    )
)
def samples_to_events(spark, sf_dir):
    made = dt.samples_to_events(samples(spark, sf_dir), 15)
    return made.select(
        "time",
        F.col("data.duration").cast("int").alias("duration_s"),
        "data.hostname",
        "data.username",
        F.col("data.idleFor").cast("bigint").alias("idle_s"),
        "data.processPath",
        tags.join_list(F.col("data.tags")).alias("tags"),
        "windowTitle",
    )


# -- streams ------------------------------------------------------------------------------


@register(RECORDED)
def recorder_stream(spark, sf_dir):
    stream = dt.stream_runtime_events(spark, log_root(spark, sf_dir, "live"), max_files_per_trigger=4)
    folder, checkpoint = shared_folder(spark, "recorded"), shared_folder(spark, "recorder-state")
    dt.start_recorder(stream, live_rules(*LIVE_CHAIN), folder, checkpoint=checkpoint).awaitTermination()
    return flat_logged(dt.read_log_root(spark, folder))


@register(RECORDED)
def recorder_flush_on_demand(spark, sf_dir):
    """A periodic recorder whose next flush is an hour away, stopped: nothing is missing."""
    folder, checkpoint = shared_folder(spark, "recorded"), shared_folder(spark, "recorder-state")

    def record_events(every_sec=None):
        stream = dt.stream_runtime_events(spark, log_root(spark, sf_dir, "live"), max_files_per_trigger=4)
        return dt.start_recorder(stream, live_rules(*LIVE_CHAIN), folder, checkpoint=checkpoint, every_sec=every_sec)

    dt.flush_and_stop(record_events(every_sec=3600), record_events)
    return flat_logged(dt.read_log_root(spark, folder))


def _written_config(spark, **content) -> str:
    """A configuration as a file that only Spark may be able to reach; its URI."""
    folder = shared_folder(spark, "config")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(folder)
    return folder


@register(RECORDED)
def recorder_from_config(spark, sf_dir):
    logs = shared_folder(spark, "configured")
    main = _written_config(
        spark,
        logDirectory=logs if "://" in logs or logs.startswith("file:") else f"file://{logs}",
        logOutputSubdirectory="recorded",
        sampleEverySec=15,
        writeEverySec=3600,
        recorderConfigPath=_written_config(spark, activeWindowEventRules=LIVE_CHAIN),
        pipelineConfigPath=None,
        pipelineOutputDirectory="unused",
        pipelineOutputFormat="parquet",
    )
    config = dt.load_job_config(main, spark)
    state = shared_folder(spark, "recorder-state")
    stream = dt.stream_runtime_events(spark, log_root(spark, sf_dir, "live"))
    dt.start_configured_recorder(stream, config, checkpoint=state, once=True).awaitTermination()
    return flat_logged(dt.read_log_root(spark, config.log_output_directory))


def _live_tables(spark, sf_dir, rules=()):
    folder, checkpoint = shared_folder(spark, "live-tables"), shared_folder(spark, "live-state")
    outputs = f"{folder}/active", f"{folder}/unlock"
    dt.start_live_tables(spark, log_root(spark, sf_dir, "mixed"), rules, *outputs, checkpoint=checkpoint).awaitTermination()
    return [spark.read.option("recursiveFileLookup", True).parquet(path) for path in outputs]


@register(RULED_ACTIVE)
def live_tables_active(spark, sf_dir):
    return flat(_live_tables(spark, sf_dir, table_rules(*CHAIN))[0])


@register(UNLOCKS)
def live_tables_unlock(spark, sf_dir):
    return _live_tables(spark, sf_dir)[1]


# -- upkeep -------------------------------------------------------------------------------

_AS_LOGGED = """SELECT CASE type WHEN 'ActiveWindowEvent' THEN 'ActiveWindowEventV1' ELSE type END AS type, ts AS time,
  hostname, CASE WHEN desktop THEN username END AS username, CASE WHEN desktop THEN path END AS "processPath",
  CASE WHEN desktop THEN array_to_string(tags, '|') END AS tags,
  CASE WHEN event_id % 10 <= 7 THEN CAST(trunc(value * 1000.0) AS BIGINT) END AS duration_ms,
  CASE WHEN desktop THEN idle END AS idle_s FROM b"""


def _nested(logs: DataFrame) -> DataFrame:
    """A log table by its nested values only: what is still flat does not show."""
    return logs.select(
        "type",
        "time",
        "data.hostname",
        "data.username",
        "data.processPath",
        tags.join_list(F.col("data.tags")).alias("tags"),
        durations.seconds_to_millis(F.col("data.duration")).alias("duration_ms"),
        F.col("data.idleFor").cast("bigint").alias("idle_s"),
    )


@register(sql.from_events(_AS_LOGGED))
def upgrade_legacy(spark, sf_dir):
    return _nested(dt.upgrade_legacy(dt.read_log_root(spark, log_root(spark, sf_dir))))


@register(ALL_ACTIVE)
def compact_logs(spark, sf_dir):
    folder = shared_folder(spark, "compacted")
    dt.compact_logs(spark, log_root(spark, sf_dir, "mixed"), folder)
    return flat(dt.active_events_from(dt.read_log_root(spark, folder)))


@register(sql.from_events(_AS_LOGGED))
def compact_and_upgrade_logs(spark, sf_dir):
    folder = shared_folder(spark, "compacted")
    dt.compact_logs(spark, log_root(spark, sf_dir, "mixed"), folder, upgrade=True)
    return _nested(dt.read_log_root(spark, folder))


def _pieces(table: str, where: str = "true", shift: str = "(piece * 60000)") -> str:
    return f"""SELECT time + to_microseconds({shift} * 1000) AS time,
      least(60000, duration_ms - piece * 60000) AS duration_ms, hostname, name, "isMobile"
    FROM (SELECT *, unnest(generate_series(0, greatest(duration_ms - 1, 0) // 60000)) AS piece
          FROM {table} WHERE "isMobile") WHERE {where}
    UNION ALL SELECT time, duration_ms, hostname, name, "isMobile" FROM {table} WHERE NOT "isMobile" AND {where}"""


def _split(anchor: str):
    def query(spark, sf_dir):
        pieces = dt.split_long_events(active(spark, sf_dir), 60, anchor=anchor)
        return flat(pieces).select("time", "duration_ms", "hostname", "name", "isMobile")

    return query


_BY_END = "(piece * 60000 + least(60000, duration_ms - piece * 60000) - duration_ms)"
for _name, _anchor, _sql in [
    ("split_long_events", "start", _pieces("a")),
    ("split_long_events_by_end", "end", _pieces("a", shift=_BY_END)),
]:
    _query = _split(_anchor)
    _query.__name__ = _name
    register(sql.from_active(_sql))(_query)


@register(sql.from_active("SELECT hostname, \"isMobile\", CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM a GROUP BY ALL"))
def split_keeps_total_duration(spark, sf_dir):
    pieces = dt.split_long_events(active(spark, sf_dir), 7)
    millis = durations.duration_to_millis(F.col("duration"))
    return pieces.groupBy("hostname", "isMobile").agg(F.sum(millis).alias("total_ms"))


# -- whole runs ---------------------------------------------------------------------------


def _run(spark, sf_dir, output_format="parquet", folder=None, rules=None, **options):
    config = JobConfig(
        log_directory=log_root(spark, sf_dir, "mixed"),
        log_output_directory=log_root(spark, sf_dir, "mixed"),
        sample_every_sec=15,
        write_every_sec=3600,
        output_directory=folder or shared_folder(spark, "run"),
        output_format=output_format,
        recorder=RecorderConfig(),
        transform=TransformConfig(table_rules(*CHAIN) if rules is None else rules, 60),
    )
    return dt.run_pipeline(spark, config, **options)


@register(RULED_ACTIVE)
def run_active_output(spark, sf_dir):
    return flat(spark.read.parquet(_run(spark, sf_dir).active_events))


@register(RULED_ACTIVE)
def run_staged_scan_active_output(spark, sf_dir):
    return flat(spark.read.parquet(_run(spark, sf_dir, scan="staged").active_events))


@register(UNLOCKS)
def run_unlock_output(spark, sf_dir):
    return spark.read.parquet(_run(spark, sf_dir).unlock_events)


@register(sql.from_events("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS time, hostname FROM b WHERE type = 'DeviceUnlockEventV1'"))
def run_unlock_output_csv(spark, sf_dir):
    return spark.read.schema("time string, hostname string").csv(_run(spark, sf_dir, "csv").unlock_events, header=True)


@register(sql.from_active(_pieces(f"t{len(CHAIN_STEPS)}", 'NOT "ignore"'), *CHAIN_STEPS))
def run_with_split_and_drop(spark, sf_dir):
    outputs = _run(spark, sf_dir, drop_ignored=True, split_long=True)
    written = flat(spark.read.parquet(outputs.active_events))
    return written.select("time", "duration_ms", "hostname", "name", "isMobile")


@register(RULED_ACTIVE)
def run_replaces_output(spark, sf_dir):
    """Two runs into one place, the first without rules: the second one's result is there."""
    folder = shared_folder(spark, "twice")
    _run(spark, sf_dir, folder=folder, rules=())
    return flat(spark.read.parquet(_run(spark, sf_dir, folder=folder).active_events))


@register(RULED_ACTIVE)
def run_output_by_date(spark, sf_dir):
    return flat(spark.read.parquet(_run(spark, sf_dir, partition_by_date=True).active_events).drop("date"))


@register(
    sql.from_events(
        """SELECT CASE event_id % 3 WHEN 0 THEN 'not an object' ELSE 'torn' END AS reason, count(*) AS lines,
             CAST(count(*) FILTER (WHERE event_id % 3 = 2) * 9 AS BIGINT) AS bytes_of_openings
           FROM b GROUP BY ALL"""
    )
)
def run_lists_refused_lines(spark, sf_dir):
    """After every line one that cannot be read: a list, an object torn at some place, or its opening."""
    root, output = shared_folder(spark, "refused-logs"), shared_folder(spark, "run")
    line = log_line()
    bad = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[1, "), F.col("event_id"), F.lit("]")))
        .when(F.col("event_id") % 3 == 1, line.substr(F.lit(1), F.lit(10) + F.pmod("event_id", F.length(line) - 11)))
        .otherwise(line.substr(1, 9))
    )
    write_lines(events(spark, sf_dir).select(F.explode(F.array(line, bad)).alias("value")), f"{root}/logs")
    outputs = dt.run_pipeline(spark, _configured(root, output, ()), scan="staged", list_refused=True)
    refused = spark.read.parquet(outputs.refused_lines)
    openings = F.sum(F.when((F.col("bytes") == 9) & (F.col("reason") == "torn"), F.col("bytes")).otherwise(0))
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), openings.alias("bytes_of_openings"))


@register(sql.from_active("SELECT time, hostname, name, duration_ms FROM a WHERE hostname = 'host3'"))
def clustered_output_of_one_host(spark, sf_dir):
    """A table laid out by host and time, read for one host."""
    folder = shared_folder(spark, "clustered")
    dt.write_table(active(spark, sf_dir), folder, "parquet", cluster_by=["hostname", "time"])
    return flat(spark.read.parquet(folder).filter("hostname = 'host3'")).select("time", "hostname", "name", "duration_ms")


# -- versioned tables ---------------------------------------------------------------------


def _configured(root: str, output: str, rules) -> JobConfig:
    return JobConfig(
        log_directory=root,
        log_output_directory=root,
        sample_every_sec=15,
        write_every_sec=3600,
        output_directory=output,
        output_format="parquet",
        recorder=RecorderConfig(),
        transform=TransformConfig(rules, 60),
    )


def _in_waves(spark, sf_dir):
    """Half of the logs, a run, the other half, a run: the folder of the tables."""
    root, output = shared_folder(spark, "waves"), shared_folder(spark, "versions")
    for wave in (0, 1):
        write_wave(spark, sf_dir, wave, f"{root}/wave-{wave}")
        dt.run_incremental(spark, _configured(root, output, table_rules(*CHAIN)))
    return output


@register(RULED_ACTIVE)
def incremental_second_run(spark, sf_dir):
    return flat(dt.read_active(spark, _in_waves(spark, sf_dir)))


@register(UNLOCKS)
def incremental_unlocks(spark, sf_dir):
    return dt.read_unlocks(spark, _in_waves(spark, sf_dir))


@register(
    sql.from_active(
        """SELECT 1 AS version, time, hostname, name FROM a WHERE event_id % 2 = 0
           UNION ALL SELECT 2, time, hostname, name FROM a"""
    )
)
def versions_side_by_side(spark, sf_dir):
    root, output = shared_folder(spark, "waves"), shared_folder(spark, "versions")
    for wave in (0, 1):
        write_wave(spark, sf_dir, wave, f"{root}/wave-{wave}")
        dt.run_incremental(spark, _configured(root, output, ()))
    tables = [dt.read_active(spark, output, version=n).select(F.lit(n).alias("version"), "time", "hostname", "name") for n in (1, 2)]
    return tables[0].unionAll(tables[1])


@register(RULED_ACTIVE)
def incremental_after_changed_files(spark, sf_dir):
    """Logs that were written again with other contents: the rows of the old ones go."""
    root, output = shared_folder(spark, "rewritten"), shared_folder(spark, "versions")
    config = _configured(root, output, table_rules(*CHAIN))
    write_wave(spark, sf_dir, 0, f"{root}/wave-0")
    write_wave(spark, sf_dir, 0, f"{root}/wave-1")
    dt.run_incremental(spark, config)
    write_wave(spark, sf_dir, 1, f"{root}/wave-1")
    dt.run_incremental(spark, config)
    return flat(dt.read_active(spark, output))


@register(RULED_ACTIVE)
def incremental_after_changed_rules(spark, sf_dir):
    """Other rules first, in another order, and some that are gone later: only rows they reach run again."""
    output = shared_folder(spark, "versions")
    root = log_root(spark, sf_dir, "mixed")
    other = [CHAIN[3], *CHAIN[:3], when(value("name", "error"), "ignore", setting("category", "wrong")), *CHAIN[5:]]
    for rules in (other, CHAIN):
        dt.run_incremental(spark, _configured(root, output, table_rules(*rules)))
    return flat(dt.read_active(spark, output))


@register(sql.from_active("SELECT time, hostname, name FROM a WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-13'"))
def active_events_of_some_days(spark, sf_dir):
    output = shared_folder(spark, "versions")
    dt.run_incremental(spark, _configured(log_root(spark, sf_dir, "mixed"), output, ()))
    return dt.read_active(spark, output, first_day="2024-01-10", last_day="2024-01-12").select("time", "hostname", "name")


def _followed(spark, sf_dir) -> tuple[str, bool]:
    """Tables kept by a stream, and whether every version read on the way was whole."""
    root, output, state = (shared_folder(spark, name) for name in ("followed", "versions", "follow-state"))
    for wave in (0, 1):
        write_wave(spark, sf_dir, wave, f"{root}/wave-{wave}")
    query = dt.follow_logs(
        spark, root, table_rules(*CHAIN), output, checkpoint=state, max_files_per_trigger=2, most_parts=2
    )
    seen = [(0, 0)]
    while query.isActive:
        seen.append((dt.read_active(spark, output).count(), dt.read_unlocks(spark, output).count()))
    if query.exception():
        raise query.exception()
    return output, seen == sorted(seen)


@register(RULED_ACTIVE)
def followed_logs_active(spark, sf_dir):
    output, whole = _followed(spark, sf_dir)
    return flat(dt.read_active(spark, output)).filter(F.lit(whole))


@register(UNLOCKS)
def followed_logs_unlocks(spark, sf_dir):
    output, whole = _followed(spark, sf_dir)
    return dt.read_unlocks(spark, output).filter(F.lit(whole))
