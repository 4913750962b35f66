"""Plan shape: pushdown, pruning, one exchange per pivot, no Python in the
wide-table plan."""

from conftest import SF_SMALL

from riskframe.operators.shape import eav_pivot_min
from riskframe.plans.analytic import LAB_CODES, analytic_dataset, label_keys, open_tables, people_side
from riskframe.sources.readers import read_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pivot_is_one_exchange(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    p = eav_pivot_min(li, "l_orderkey", "l_returnflag", "l_extendedprice", LAB_CODES)
    plan = _plan(p)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "In(l_returnflag" in plan or "l_returnflag IN" in plan.replace("In(", "l_returnflag IN")


def test_label_scan_pushdown_and_pruning(spark):
    plan = _plan(label_keys(read_table(spark, SF_SMALL, "lineitem"), read_table(spark, SF_SMALL, "part")))
    assert "EqualTo(l_returnflag,R)" in plan
    assert "StringStartsWith(p_brand,Brand#7" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_wide_plan_has_no_python(spark):
    plan = _plan(analytic_dataset(spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the cohort filter reaches the customer scan, which is written before the join
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in _plan(people_side(open_tables(spark, SF_SMALL)))
