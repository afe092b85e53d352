import os
import sys

import pytest

import __spark_entry__ as entry_module
from tables import MEDIUM, SMALL
from workload import oracle, queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect  # noqa: E402

STATEMENTS = oracle.statements()


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(queries.QUERIES) == set(STATEMENTS)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert [r["lob"] for r in rows] == ["auto", "health", "home", "liability"]


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, database, name):
    _, count, problems = compare(spark, database, SMALL, name, entry_module.queries()[name], STATEMENTS[name])
    assert not problems
    assert count > 0


def test_known_values(spark):
    queries = entry_module.queries()
    assert queries["auc"](spark, MEDIUM).first()["auc"] == 0.821622
    assert queries["avg_precision"](spark, MEDIUM).first()["avg_precision"] == 0.230204
    assert queries["topk_15"](spark, MEDIUM).first()["churners_captured"] == 45
    assert tuple(queries["at_risk_summary"](spark, MEDIUM).first()) == (117, 110510.0)
    total = queries["clv"](spark, MEDIUM).agg({"estimated_clv": "sum"}).first()[0]
    assert round(total, 2) == 2604337.57
    assert {r["rule"]: r["n_rejected"] for r in queries["reject_counts"](spark, MEDIUM).collect()} == {
        "policy_id": 75, "lob": 75, "channel": 75, "annual_premium": 225, "insured_age": 150,
        "claim_settled_pct": 75, "policy_count_active": 75}
    importance = {r["feature"]: r["mean_abs_contribution"] for r in queries["importance"](spark, MEDIUM).collect()}
    assert importance == {"tenure_months": 0.788439, "claim_count_12m": 0.636743, "premium_change_pct": 0.150658}
    row = queries["drift_summary"](spark, MEDIUM).first()
    assert row["share_drifted_features"] == 0.818182 and row["alert"]
