"""What the plans must and must not contain."""

import io
import re
from contextlib import redirect_stdout

import pytest

from tables import SMALL
from workload import inputs
from workload.queries import QUERIES

ROW_QUERIES = [
    "translate", "validate_rules", "feat_premium", "feat_claims", "feat_loyalty", "global_rank", "split_ordered",
    "time_folds", "prediction_rows", "batch_result", "topk_15", "gains_curve", "auc", "roc_points", "eval_report",
    "ks_columns", "profile_describe", "corr_matrix", "contributions", "at_risk_summary",
]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ROW_QUERIES)
def test_rows_stay_in_the_jvm_and_are_never_gathered(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "EvalPython" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A window over everything may only run over slice totals, which come out of an aggregate.
    for single in re.findall(r"Exchange SinglePartition", text):
        assert "HashAggregate" in text, single


def test_scans_read_only_what_is_asked(spark):
    text = plan(QUERIES["rate_by_lob"](spark, SMALL))
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"lob", "churn_label"}
    text = plan(inputs.policies(spark, SMALL).where("tenure_months > 30").select("policy_id"))
    assert "GreaterThan(tenure_months,30)" in text


def test_translation_and_features_do_not_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["translate"](spark, SMALL))
    text = plan(QUERIES["feat_premium"](spark, SMALL))
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_cut_needs_no_sort_of_the_rows(spark):
    text = plan(QUERIES["topk_15"](spark, SMALL))
    assert "Sort" not in text.replace("SortAggregate", "") and "hashpartitioning" not in text


def test_lines_no_count_can_take_are_left_out_before_the_parts(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("part", [(1, "ECONOMY"), (1, "ECONOMY"), (2, "STANDARD"), (None, "LARGE")], "p_partkey long, p_type string")
    write("customer", [(c, 3, "BUILDING") for c in (1, 2, 3)], "c_custkey long, c_nationkey int, c_mktsegment string")
    write("orders", [(10, 1, "1-URGENT"), (11, 1, "5-LOW"), (12, 2, "2-HIGH"), (12, 2, "2-HIGH"), (None, 3, "2-HIGH")],
          "o_orderkey long, o_custkey long, o_orderpriority string")
    write("lineitem", [
        (10, 1, 30.0, 0.0, 0.0, "N"), (10, 1, 29.0, 0.0, 0.0, "N"), (11, 2, 40.0, 0.1, 0.08, "R"), (11, 9, 40.0, 0.1, 0.08, "R"),
        (12, 2, None, 0.1, None, "R"), (12, 1, None, 0.1, 0.08, None), (12, None, 50.0, 0.1, 0.08, "R"),
        (None, 1, 50.0, 0.1, 0.08, "R")],
        "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string")
    raw = inputs.build_raw_contracts(spark, str(tmp_path))
    found = {r["client_no"]: (r["PPERSAUT"], r["PBRAND"], r["AWAPART"], r["APERSAUT"], r["MAANTHUI"]) for r in raw.collect()}
    assert found == {1: (2, 0, 1, 1, 1), 2: (0, 0, 2, 0, 2), 3: (0, 0, 0, 0, 1)}
    filters = re.findall(r"Condition : .*", plan(raw))
    assert any("l_partkey" in f and "l_quantity" in f and "l_tax" in f for f in filters)
