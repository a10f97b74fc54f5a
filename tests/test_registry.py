"""Every registered query runs at the smallest scale; plans have the intended shape."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from usagelens.registry.views import Views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one per module here; tools/check_oracle.py runs all of them at a larger scale
CHECKED = ["ag01_max_wins_dedup", "ag29_cost_by_model", "ag08_distribution_summary", "ag14_mann_whitney", "rl01_findings", "jn02_pairs_across_chunks",
           "ag22_weekday_split", "jn12_repo_components", "mg06_merged_verdict", "src03_prj01_request_rows", "st02_running_largest"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, df.collect()) == normal(columns, cur.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_limits_groups_before_the_shuffle(spark, sf):
    text = plan(Views(spark, sf).dedup)
    assert re.search(r"WindowGroupLimit .*Partial", text) and re.search(r"WindowGroupLimit .*Final", text)


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(Views(spark, sf).sided.groupBy("model").count())
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "l_orderkey" in scan and "c_name" not in text
    assert "o_totalprice" not in text and "p_retailprice" not in text


@pytest.mark.parametrize("name", ["ag08_distribution_summary", "ag14_mann_whitney", "ag13_clipped_histogram", "jn02_call_result_pairs", "ag22_weekday_split", "jn09_tool_failure_comparison"])
def test_no_cross_join_and_no_python_rows(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
