"""Shape of the physical plans: pruned scans, pushed filters, one shuffle for an as-of join."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import SF
from tickloom.operators.asof import asof_join
from tickloom.plans.roles import DAY, ticks

QUERIES = contract.queries()

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_asof_shuffles_each_side_once(spark):
    t = ticks(spark, SF)
    out = asof_join(t, t, by=["instrument"], at=F.col("ts") - 1, tol=DAY, take={"px": "p"}, chunk=DAY)
    text = plan(out)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["signed_net_exposure"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} <= {"l_suppkey", "l_quantity", "l_returnflag"}


def test_filters_reach_the_scan(spark):
    text = plan(ticks(spark, SF).filter("instrument = 'view'"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
