import pytest
from pyspark.sql import functions as F

from policylens.functions.tiers import retention_action, risk_tier, tier_rank
from policylens.functions.value import lifetime_value
from policylens.operators import attribution as at
from policylens.operators import scoring as sc


def tiers(spark, closed, values):
    df = spark.createDataFrame([(v,) for v in values], "p double")
    return {r["p"]: r["t"] for r in df.select("p", risk_tier(F.col("p"), closed).alias("t")).collect()}


def test_online_edges_open_the_next_tier(spark):
    assert tiers(spark, "left", [0.0, .199, .2, .45, .7, 1.0, -.1, 1.1]) == {
        0.0: "low", .199: "low", .2: "medium", .45: "high", .7: "critical", 1.0: "critical",
        -.1: "critical", 1.1: "critical"}


def test_batch_edges_close_the_tier(spark):
    assert tiers(spark, "right", [0.0, .2, .201, .45, .7, 1.0, -.1, 1.1]) == {
        0.0: "low", .2: "low", .201: "medium", .45: "medium", .7: "high", 1.0: "critical",
        -.1: None, 1.1: None}
    with pytest.raises(ValueError):
        risk_tier(F.col("p"), "both")


def test_rank_and_action(spark):
    df = spark.createDataFrame([("low",), ("medium",), ("high",), ("critical",), (None,)], "t string")
    got = {r["t"]: (r["k"], r["a"]) for r in df.select(
        "t", tier_rank(F.col("t")).alias("k"), retention_action(F.col("t")).alias("a")).collect()}
    assert got == {"low": (0, "no_action"), "medium": (1, "soft_retention"), "high": (2, "proactive_outreach"),
                   "critical": (3, "urgent_retention"), None: (None, None)}


def test_lifetime_value(spark):
    df = spark.createDataFrame([(1000.0, 24), (1000.0, 6), (1000.0, 48), (1000.0, 500), (2000.0, 24), (850.0, 24)],
                               "p double, t int")
    got = [r[0] for r in df.select(lifetime_value(F.col("p"), F.col("t"))).collect()]
    assert got[0] == 2577.10 and got[2] == got[3] == 925.93 and got[5] == 2190.53
    assert got[1] > got[0] > got[2] > 0 and got[4] > got[0]


def test_at_risk_uses_first_premium(spark):
    df = spark.createDataFrame([
        ("A", 100.0, 0.9, 1), ("A", 999.0, 0.9, 5), ("B", 50.0, 0.1, 2), ("B", 70.0, 0.6, 3), ("C", 10.0, 0.2, 4),
    ], "policy_id string, annual_premium double, churn_probability double, pos long")
    assert tuple(sc.at_risk_summary(df.repartition(3)).first()) == (3, 250.0)
    assert tuple(sc.at_risk_summary(df.where("policy_id = 'C'")).first()) == (0, 0.0)


def test_batch_result_with_and_without_id(spark):
    df = spark.createDataFrame([("A", 0.45)], "policy_id string, churn_probability double")
    assert sc.batch_result(df).first().asDict() == {
        "policy_id": "A", "churn_probability": 0.45, "risk_tier": "medium"}
    assert sc.batch_result(df.drop("policy_id")).columns == ["churn_probability", "risk_tier"]


def test_prediction_tier_comes_from_the_unrounded_score(spark, five):
    row = sc.prediction_rows(five.withColumn("churn_probability", F.lit(0.19999)), "m", "s").first()
    assert row["churn_probability"] == 0.2 and row["risk_tier"] == "low" and row["model_version"] == "m@s"


def test_contributions_add_up_to_the_score(spark, five):
    weights = {"tenure_months": -0.07, "claim_count_12m": 0.6}
    rows = at.contributions(five, weights)
    total = rows.groupBy("policy_id").agg(F.sum("contribution").alias("c")).join(five, "policy_id")
    margin = F.col("tenure_months") * -0.07 + F.col("claim_count_12m") * 0.6
    gaps = [r[0] for r in total.select(margin - F.col("c")).collect()]
    assert max(gaps) == pytest.approx(min(gaps))
    extremes = at.explain_extremes(five.withColumn("p", margin), weights, "p").collect()
    assert {(r["extreme"], r["policy_id"]) for r in extremes} == {("highest", "POL003"), ("lowest", "POL005")}
    assert abs(extremes[0]["contribution"]) >= abs(extremes[1]["contribution"])
