import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from policylens.operators import features as ft
from policylens.schema import LABEL

FLAGS = [
    "is_overpriced", "premium_increased", "premium_increase_gt5pct", "has_recent_claim", "multi_claim",
    "has_unsettled_claim", "slow_settlement", "is_new_customer", "is_loyal_customer", "never_renewed",
    "long_since_contact", "is_multi_line", "multi_line_discount_eligible", "is_young_adult",
    "is_online_customer", "is_broker_customer",
]
GOLDEN = {
    "premium_to_market_ratio": [8 / 9, 1, 4 / 3, 1, 1],
    "is_overpriced": [0, 0, 1, 0, 0],
    "premium_increased": [0, 1, 1, 0, 1],
    "premium_increase_gt5pct": [0, 0, 1, 0, 0],
    "has_recent_claim": [0, 1, 1, 0, 0],
    "multi_claim": [0, 0, 1, 0, 0],
    "claims_per_year": [0.5, 0.6, 4, 0, 0.5],
    "has_unsettled_claim": [0, 1, 1, 0, 0],
    "slow_settlement": [0, 1, 1, 0, 0],
    "tenure_years": [2, 5, 0.5, 3, 10],
    "is_new_customer": [0, 0, 1, 0, 0],
    "is_loyal_customer": [0, 1, 0, 0, 1],
    "never_renewed": [0, 0, 1, 0, 0],
    "long_since_contact": [0, 1, 0, 0, 1],
    "is_multi_line": [0, 1, 0, 1, 1],
    "multi_line_discount_eligible": [0, 1, 0, 1, 1],
    "age_segment_encoded": [1, 3, 0, 2, 4],
    "is_young_adult": [0, 0, 1, 0, 0],
    "is_online_customer": [0, 0, 1, 0, 0],
    "is_broker_customer": [0, 1, 0, 0, 0],
    "log_premium": [math.log(1 + p) for p in (800, 520, 1200, 600, 900)],
    "log_tenure": [math.log(1 + t) for t in (24, 60, 6, 36, 120)],
    "log_renewals": [math.log(1 + r) for r in (2, 5, 0, 3, 10)],
}


@pytest.fixture(scope="module")
def derived(five):
    return ft.add_features(five, ft.fit_market(five))


def test_medians(five):
    assert {r["lob"]: r["market_median"] for r in ft.fit_market(five).collect()} == {
        "auto": 900.0, "home": 520.0, "health": 600.0}


def test_golden_values(derived):
    got = derived.orderBy("policy_id").collect()
    assert len(got) == 5
    for column, expected in GOLDEN.items():
        assert [r[column] for r in got] == pytest.approx(expected), column
    assert set(GOLDEN) == set(derived.columns) - {c for c in derived.columns if c not in GOLDEN}


def test_all_23_derived(five, derived):
    assert [c for c in derived.columns if c not in five.columns] == [
        c for c in sorted(GOLDEN, key=derived.columns.index)]
    assert len(derived.columns) - len(five.columns) == 23


def test_matrix_has_34_numeric_columns(five_labelled):
    matrix = ft.build_feature_matrix(five_labelled)
    assert len(matrix.columns) == 34
    assert not {"policy_id", "lob", "channel", LABEL} & set(matrix.columns)
    assert all(kind in ("int", "double") for _, kind in matrix.dtypes)
    kept = ft.training_features(five_labelled)
    assert kept.columns[:2] == ["policy_id", LABEL] and kept.columns[2:] == matrix.columns


def test_flags_survive_missing_input(spark, five):
    empty = five.select("policy_id", "lob", *[
        F.lit(None).cast(kind).alias(c) for c, kind in five.dtypes if c not in ("policy_id", "lob")])
    out = ft.add_features(empty, ft.fit_market(five)).collect()
    for row in out:
        assert all(row[f] == 0 for f in FLAGS)
        assert row["claims_per_year"] is None and row["age_segment_encoded"] is None


def test_unknown_line_has_ratio_one_and_fitted_null_median_gives_null(spark, five):
    state = spark.createDataFrame([("auto", None), ("home", 260.0)], "lob string, market_median double")
    out = {r["policy_id"]: r["premium_to_market_ratio"] for r in ft.add_features(five, state).collect()}
    assert out == {"POL001": None, "POL002": 2.0, "POL003": None, "POL004": 1.0, "POL005": None}


def test_groups_follow_the_columns_present(five):
    out = ft.add_features(five.drop("annual_premium", "tenure_months", "channel"), ft.fit_market(five))
    new = set(out.columns) - set(five.columns)
    assert "premium_to_market_ratio" not in new and "tenure_years" not in new and "claims_per_year" not in new
    assert {"premium_increased", "has_recent_claim", "never_renewed", "age_segment_encoded"} <= new
    assert ft.fit_market(five.drop("lob")).count() == 0


def test_pipeline_stage_agrees_and_reloads(spark, five, derived, tmp_path):
    fitted = Pipeline(stages=[ft.MarketFeatures(statePath=str(tmp_path / "medians"))]).fit(five)
    path = str(tmp_path / "stage")
    fitted.save(path)
    reloaded = PipelineModel.load(path)
    expected = sorted(map(tuple, derived.collect()), key=repr)
    for model in (fitted, reloaded):
        out = model.transform(five).select(*derived.columns)
        assert sorted(map(tuple, out.collect()), key=repr) == expected
    assert {r["lob"]: r["market_median"] for r in reloaded.stages[0].state(spark).collect()} == {
        "auto": 900.0, "home": 520.0, "health": 600.0}


def test_stage_learns_any_number_of_lines(spark, tmp_path):
    many = spark.range(3000).select(
        F.format_string("line%d", "id").alias("lob"), F.col("id").cast("double").alias("annual_premium"))
    fitted = ft.MarketFeatures(statePath=str(tmp_path / "medians")).fit(many)
    assert fitted.state(spark).count() == 3000
    assert fitted.transform(many).where(
        "annual_premium > 0 AND premium_to_market_ratio != 1").count() == 0


def test_grid_of_valid_inputs(spark):
    grid = spark.sql("""
        SELECT format_string('P%d', row_number() OVER (ORDER BY p, t, a, c)) AS policy_id, 'auto' AS lob,
          p AS annual_premium, t AS tenure_months, 0 AS renewal_count, c AS claim_count_12m,
          c AS claim_count_all, 1.0D AS claim_settled_pct, 30.0D AS days_to_settle_avg, a AS insured_age,
          'Direct' AS channel, 1 AS policy_count_active, 0.0D AS premium_change_pct
        FROM VALUES (100.0D), (437.5D), (50000.0D) AS x(p), VALUES (1), (11), (12), (600) AS y(t),
          VALUES (18), (25), (26), (65), (66), (100) AS z(a), VALUES (0), (1), (20) AS w(c)""")
    out = ft.build_feature_matrix(grid, keep=["policy_id"])
    checked = out.agg(
        F.count("*").alias("n"), F.min("log_premium").alias("log"), F.count("age_segment_encoded").alias("ages"),
        *[F.count_if(F.col(f).isin(0, 1)).alias(f) for f in FLAGS if f in out.columns]).first()
    assert checked["n"] == 3 * 4 * 6 * 3 and checked["log"] > 0 and checked["ages"] == checked["n"]
    assert all(checked[f] == checked["n"] for f in FLAGS if f in out.columns)


def test_catalogue(five):
    rows = ft.feature_catalog(five, ft.fit_market(five)).orderBy("position").collect()
    assert len(rows) == 23 and sum(r["description"] != "" for r in rows) == 15
    assert rows[0]["feature"] == "premium_to_market_ratio" and rows[0]["n_present"] == 5
    assert rows[1]["mean"] == 0.2
