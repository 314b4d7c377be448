"""Rule semantics: single cases, and random rule lists against a row-by-row reading of them."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import dwelltrace
from dwelltrace.operators import rules as R
from dwelltrace.operators.live import flat_live_events
from dwelltrace.schemas import ACTIVE_SCHEMA, RUNTIME_EVENT_SCHEMA, WINDOW_DATA_SCHEMA

TIME = dt.datetime(2026, 1, 1)


def event(**values):
    base = dict.fromkeys(ACTIVE_SCHEMA.fieldNames())
    base |= {"time": TIME, "ignore": False, "isMobile": False, "tags": []}
    base |= values
    if base["idleFor"] is not None:
        base["idleFor"] = dt.timedelta(seconds=base["idleFor"])
    return base


def table(spark, *events):
    rows = [tuple(e[c] for c in ACTIVE_SCHEMA.fieldNames()) for e in events]
    return spark.createDataFrame(rows, ACTIVE_SCHEMA).coalesce(1)


def run(spark, events, *rules, dialect=R.TABLE_RULES):
    return [r.asDict() for r in dwelltrace.apply_rules(table(spark, *events), rules, dialect).collect()]


def fires(spark, predicate, **values):
    (row,) = run(spark, [event(**values)], R.Rule(predicate, (R.Ignore(),)))
    return row["ignore"]


# -- null logic --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "predicate, fired",
    [
        (R.AttributeValue("name", "x"), False),
        (R.Not(R.AttributeValue("name", "x")), True),
        (R.AttributeRegex("name", "x"), False),
        (R.Not(R.AttributeRegex("name", "x")), False),
        (R.Not(R.AttributeRegex("name", "x|y")), False),
        (R.IdleForGreaterThan(1), False),
        (R.Not(R.IdleForGreaterThan(1)), False),
        (R.Or((R.AttributeRegex("name", "x"), R.And(()))), True),
        (R.And((R.AttributeRegex("name", "x"), R.Or(()))), False),
        (R.Not(R.And((R.AttributeRegex("name", "x"), R.Or(())))), True),
        (R.Not(R.HasTag("t")), True),
        (R.IsMobile(), False),
        (R.Not(R.IsMobile()), True),
        (R.And(()), True),
        (R.Or(()), False),
    ],
)
def test_table_rules_on_missing_values(spark, predicate, fired):
    assert fires(spark, predicate) is fired


def test_has_tag_next_to_a_null_tag(spark):
    assert fires(spark, R.Not(R.HasTag("t")), tags=["a", None]) is True
    assert fires(spark, R.HasTag("t"), tags=[None, "t"]) is True


def test_idle_limit_is_strict(spark):
    assert fires(spark, R.IdleForGreaterThan(300), idleFor=300) is False
    assert fires(spark, R.IdleForGreaterThan(300), idleFor=300.001) is True


# -- actions -----------------------------------------------------------------------------


ALWAYS = R.And(())


def test_tags_are_added_once_in_order_and_duplicates_survive(spark):
    rule = R.Rule(ALWAYS, (R.AddTag("b"), R.AddTag("a"), R.AddTag("c"), R.AddTag("c")))
    (row,) = run(spark, [event(tags=["a", "a", None])], rule)
    assert row["tags"] == ["a", "a", None, "b", "c"]


def test_order_of_tags_follows_the_rule_that_added_first(spark):
    a, b = R.AttributeValue("hostname", "h1"), R.AttributeValue("username", "u")
    rules = [R.Rule(a, (R.AddTag("x"),)), R.Rule(b, (R.AddTag("y"),)), R.Rule(ALWAYS, (R.AddTag("x"),))]
    got = run(spark, [event(hostname="h1", username="u"), event(hostname="h2", username="u")], *rules)
    assert [r["tags"] for r in got] == [["x", "y"], ["y", "x"]]


def test_actions_of_one_rule_see_the_row_before_it(spark):
    rule = R.Rule(R.AttributeValue("name", "a"), (R.SetAttribute("name", "b"), R.AddTag("t"), R.SetAttribute("category", "c")))
    (row,) = run(spark, [event(name="a")], rule)
    assert (row["name"], row["tags"], row["category"]) == ("b", ["t"], "c")


def test_later_rules_see_earlier_ones(spark):
    rules = [
        R.Rule(R.AttributeValue("name", "a"), (R.SetAttribute("name", "b"),)),
        R.Rule(R.AttributeValue("name", "a"), (R.AddTag("stale"),)),
        R.Rule(R.AttributeRegex("name", "^b$"), (R.AddTag("fresh"),)),
        R.Rule(R.HasTag("fresh"), (R.SetAttribute("category", "seen"),)),
    ]
    (row,) = run(spark, [event(name="a")], *rules)
    assert (row["tags"], row["category"]) == (["fresh"], "seen")


def test_setting_the_path_leaves_the_names_alone(spark):
    (row,) = run(spark, [event(processPath="/a/b", processName="b", name="b")], R.Rule(ALWAYS, (R.SetAttribute("processPath", "/c/d"),)))
    assert (row["processPath"], row["processName"], row["name"]) == ("/c/d", "b", "b")


def test_ignore_flags_and_drop_ignored_drops(spark):
    df = dwelltrace.apply_rules(table(spark, event(name="a"), event(name="b")), [R.Rule(R.AttributeValue("name", "a"), (R.Ignore(),))])
    assert df.count() == 2
    assert [r.name for r in dwelltrace.drop_ignored(df).collect()] == ["b"]


def test_columns_keep_their_order_and_no_rules_change_nothing(spark):
    df = table(spark, event(name="a"))
    assert dwelltrace.apply_rules(df, []).collect() == df.collect()
    assert dwelltrace.apply_rules(df, [R.Rule(ALWAYS, ())]).collect() == df.collect()
    assert dwelltrace.apply_rules(df, [R.Rule(ALWAYS, (R.Ignore(),))]).columns == ACTIVE_SCHEMA.fieldNames()


def test_independent_rules_share_a_projection(spark):
    rules = [R.Rule(R.AttributeRegex("processPath", f"a{i}|b"), (R.SetAttribute("category", f"c{i}"), R.AddTag(f"t{i}"))) for i in range(60)]
    df = spark.createDataFrame([], ACTIVE_SCHEMA).unionAll(table(spark, event()))
    plan = dwelltrace.apply_rules(df, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Project" in line for line in plan.splitlines()) <= 4


# -- against a literal reading -----------------------------------------------------------

TAGS = ["t1", "t2", "t3"]
VALUES = ["a", "b", "ab"]
TABLE_ATTRIBUTES = ["name", "category", "processPath", "hostname"]
LIVE_ATTRIBUTES = ["windowTitle", "processPath", "processName", "hostname"]


def holds(p, row, missing_is_false):
    """Three-valued truth of a predicate on one row."""
    def go(q):
        return holds(q, row, missing_is_false)

    match p:
        case R.AttributeValue(name, value):
            return row[name] == value
        case R.AttributeRegex(name, pattern):
            if row[name] is None:
                return False if missing_is_false else None
            return any(word in row[name] for word in pattern.split("|"))
        case R.HasTag(tag):
            return tag in row["tags"]
        case R.IsMobile():
            return row["isMobile"]
        case R.IdleForGreaterThan(seconds):
            return None if row["idleFor"] is None else row["idleFor"] > dt.timedelta(seconds=seconds)
        case R.And(parts):
            truths = [go(q) for q in parts]
            return False if False in truths else (None if None in truths else True)
        case R.Or(parts):
            truths = [go(q) for q in parts]
            return True if True in truths else (None if None in truths else False)
        case R.Not(part):
            truth = go(part)
            return None if truth is None else not truth


def follow(rules, row, missing_is_false):
    """The row after all rules, or None if it was deleted."""
    row = dict(row, tags=list(row["tags"]))
    for rule in rules:
        if holds(rule.predicate, row, missing_is_false) is not True:
            continue
        for action in rule.actions:
            match action:
                case R.AddTag(tag) if tag not in row["tags"]:
                    row["tags"].append(tag)
                case R.SetAttribute(name, value):
                    row[name] = value
                case R.Ignore():
                    row["ignore"] = True
                case R.RedactProcess():
                    row["processPath"] = row["processName"] = None
                case R.Delete():
                    return None
    return row


def predicates(leaves):
    return st.recursive(
        leaves,
        lambda p: st.one_of(
            st.builds(R.Not, p),
            st.lists(p, max_size=3).map(lambda ps: R.And(tuple(ps))),
            st.lists(p, max_size=3).map(lambda ps: R.Or(tuple(ps))),
        ),
        max_leaves=4,
    )


def rule_lists(attributes, leaves, actions):
    named = st.sampled_from(attributes)
    common = st.one_of(
        st.builds(R.AttributeValue, named, st.sampled_from(VALUES)),
        st.builds(R.AttributeRegex, named, st.sampled_from(["a", "b", "a|b", "zz"])),
        st.builds(R.HasTag, st.sampled_from(TAGS)),
        *leaves,
    )
    acts = st.lists(st.one_of(st.builds(R.AddTag, st.sampled_from(TAGS)), *actions), min_size=1, max_size=3)
    rule = st.builds(lambda p, a: R.Rule(p, tuple(a)), predicates(common), acts)
    return st.lists(rule, min_size=1, max_size=7)


def sample_rows(attributes, extra):
    maybe = st.one_of(st.none(), st.sampled_from(VALUES))
    return st.lists(
        st.fixed_dictionaries(
            {**{a: maybe for a in attributes}, "tags": st.lists(st.sampled_from(TAGS), max_size=2), **extra}
        ),
        min_size=12, max_size=12,
    )


HEAVY = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))


@HEAVY
@given(
    rules=rule_lists(
        TABLE_ATTRIBUTES,
        [st.just(R.IsMobile()), st.builds(R.IdleForGreaterThan, st.sampled_from([0, 5]))],
        [st.builds(R.SetAttribute, st.sampled_from(TABLE_ATTRIBUTES), st.sampled_from(VALUES)), st.just(R.Ignore())],
    ),
    rows=sample_rows(TABLE_ATTRIBUTES, {"isMobile": st.booleans(), "idleFor": st.sampled_from([None, 0, 5, 9])}),
)
def test_random_table_rules(spark, rules, rows):
    events = [event(**r) for r in rows]
    assert run(spark, events, *rules) == [follow(rules, e, missing_is_false=False) for e in events]


@HEAVY
@given(
    rules=rule_lists(LIVE_ATTRIBUTES, [], [st.just(R.RedactProcess()), st.just(R.Delete())]),
    rows=sample_rows(["windowTitle", "processPath", "hostname"], {}),
)
def test_random_live_rules(spark, rules, rows):
    def runtime(r):
        data = {f.name: r.get(f.name) for f in WINDOW_DATA_SCHEMA.fields}
        return (TIME, tuple(data.values()), r["windowTitle"])

    events = spark.createDataFrame([runtime(r) for r in rows], RUNTIME_EVENT_SCHEMA).coalesce(1)
    out = dwelltrace.transform_live_events(events.withColumn("time", F.col("time").cast("timestamp_ntz")), rules).collect()
    got = [(r.data.processPath, r.data.hostname, r.data.tags, r.windowTitle) for r in out]
    # The paths used here have no separator and no dot, so the name is the path.
    literal = [follow(rules, dict(r, processName=r["processPath"]), missing_is_false=True) for r in rows]
    assert got == [(r["processPath"], r["hostname"], r["tags"], r["windowTitle"]) for r in literal if r]


# -- live rules --------------------------------------------------------------------------


def live_event(spark, path="/bin/app", title="t", tags=()):
    row = (TIME, (15.0, "h", "u", 0.0, path, list(tags)), title)
    return spark.createDataFrame([row], RUNTIME_EVENT_SCHEMA).withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_live_not_regex_on_a_missing_path_fires(spark):
    rule = R.Rule(R.Not(R.AttributeRegex("processPath", "x")), (R.AddTag("t"),))
    (row,) = dwelltrace.transform_live_events(live_event(spark, path=None), [rule]).collect()
    assert row.data.tags == ["t"]


def test_redaction_does_not_disturb_its_own_rule_but_later_ones(spark):
    named = R.AttributeValue("processName", "app")
    rules = [R.Rule(named, (R.RedactProcess(), R.AddTag("same"))), R.Rule(named, (R.AddTag("later"),))]
    (row,) = dwelltrace.transform_live_events(live_event(spark), rules).collect()
    assert (row.data.processPath, row.data.tags) == (None, ["same"])


def test_live_names_drop_any_extension(spark):
    assert flat_live_events(live_event(spark, "/usr/bin/python3.11")).first().processName == "python3"


def test_states_of_one_depth_build_on_each_other(spark):
    key = "spark.sql.lateralColumnAlias.enableImplicitResolution"
    rules = [
        R.Rule(R.AttributeValue("hostname", "h"), (R.SetAttribute("name", "x"),)),
        R.Rule(R.AttributeValue("name", "x"), (R.AddTag("saw x"),)),
        R.Rule(R.AttributeValue("username", "u"), (R.SetAttribute("name", "y"),)),
        R.Rule(R.AttributeRegex("name", "x|y"), (R.AddTag("saw either"),)),
        R.Rule(R.AttributeValue("name", "y"), (R.AddTag("saw y"),)),
    ]
    events = [event(hostname=h, username=u) for h in ("h", "i") for u in ("u", "v")]
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert run(spark, events, *rules) == [follow(rules, e, False) for e in events]
    finally:
        spark.conf.set(key, before)


def test_hundreds_of_rules_stay_within_the_optimizer(spark):
    n = 300
    match = [R.AttributeRegex("name", f"x{i}y|z{i}y") for i in range(n)]
    rules = [R.Rule(p, (R.AddTag("t"),)) for p in match] + [R.Rule(R.Or(tuple(match)), (R.Ignore(),))]
    (row,) = run(spark, [event(name=f"z{n - 1}y")], *rules)
    assert (row["tags"], row["ignore"]) == (["t"], True)
    deletes = [R.Rule(p, (R.Delete(),)) for p in match]
    assert dwelltrace.apply_rules(table(spark, event(name="x7y"), event(name="a")), deletes, R.LIVE_RULES).count() == 1


# -- patterns tried once per value -----------------------------------------------------------


@pytest.mark.parametrize("most_values", [100_000, 2, -1])
def test_rules_by_value_equal_rules_by_row(spark, monkeypatch, most_values):
    """Attributes with nulls, patterns before and after a rule that writes what they search."""
    rows = [(i, n, p) for i, (n, p) in enumerate((n, p) for n in ["ab", "b", None, "", "x y"] for p in ["/a", None, "/b/a"])]
    df = spark.createDataFrame(rows, "id int, name string, processPath string")
    df = df.withColumns({"category": F.lit(None).cast("string"), "ignore": F.lit(False), "tags": F.array().cast("array<string>")})
    rng = random.Random(7)
    rules = []
    for k in range(90):
        search = R.AttributeRegex(rng.choice(["name", "processPath", "category"]), rng.choice("abxy/ ") + rng.choice(["", "$", "?b", ".*"]))
        predicate = rng.choice([search, R.Not(search), R.And((search, R.Not(R.HasTag("t3")))), R.Or((R.Not(search), R.HasTag("t5")))])
        action = R.SetAttribute(rng.choice(["name", "category"]), rng.choice(["ab", "y"])) if k > 60 and k % 9 == 0 else R.AddTag(f"t{k % 11}")
        rules.append(R.Rule(predicate, (action,)))
    monkeypatch.setattr(R, "_MANY_SEARCHES", 3)
    by_value = R.apply_rules_by_value(df, rules, most_values=most_values)
    assert by_value.columns == df.columns
    assert sorted(by_value.collect()) == sorted(R.apply_rules(df, rules).collect())
    joined = "BroadcastHashJoin" in by_value._jdf.queryExecution().executedPlan().toString()
    assert joined == (most_values > 0)


def test_few_patterns_are_tried_by_row(spark):
    df = spark.createDataFrame([("a", False, [])], "name string, ignore boolean, tags array<string>")
    plan = R.apply_rules_by_value(df, [R.Rule(R.AttributeRegex("name", "a+b"), (R.Ignore(),))])
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
