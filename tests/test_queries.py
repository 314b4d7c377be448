"""Every registered query against its SQL counterpart, on whole tables."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from querybook.catalogue import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return connection


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    result = queries()[name](spark, DATA)
    expected = duck.execute(oracle_sql()[name])
    expected_names = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(expected_names)
    ours = multiset(result.columns, [tuple(row) for row in result.collect()])
    theirs = multiset(expected_names, expected.fetchall())
    assert sum(theirs.values()) > 0
    assert ours == theirs


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("absent", [["dwelltrace.llm"], ["tiktoken"], ["corpus_pipeline"], ["dwelltrace.llm", "corpus_pipeline"]])
def test_the_corpus_operators_may_be_absent(absent):
    """Without them, or without a library they need, the other queries are there."""
    program = (
        "import sys\n"
        f"sys.modules.update(dict.fromkeys({absent!r}))\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), 'rule_chain' in e.queries(), 'pipeline' in e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", program], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, chain, pipeline = done.stdout.split()
    assert int(count) >= len(QUERIES) and (chain, pipeline) == ("True", "False")


def test_long_values_are_searched_once_each(spark):
    """The searches run before the join, on distinct values."""
    plan = queries()["regex_on_long_values"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    before, shuffle, after = plan.partition("Repartition ")
    assert shuffle and "RLIKE" in after and "Aggregate" in after
    assert "RLIKE" not in before and "Join" in before
