import pytest
from pyspark.sql import functions as F

from policylens.operators import validate as va
from policylens.schema import REQUEST

REQUIRED = ("P1", "auto", 500.0, 12, 40, "Direct")
NAMES = "policy_id string, lob string, annual_premium double, tenure_months int, insured_age int, channel string"


def frame(spark, **changes):
    names = [part.split()[0] for part in NAMES.split(", ")]
    return spark.createDataFrame([tuple({**dict(zip(names, REQUIRED)), **changes}[n] for n in names)], NAMES)


def reasons(df, **options):
    return va.check(df, **options).first()["reasons"]


def test_required_fields_are_enough(spark):
    row = va.valid_rows(va.check(frame(spark))).first()
    assert (row["renewal_count"], row["claim_count_12m"], row["claim_count_all"]) == (0, 0, 0)
    assert (row["claim_settled_pct"], row["days_to_settle_avg"]) == (1.0, 30.0)
    assert (row["policy_count_active"], row["premium_change_pct"], row["last_contact_days"]) == (1, 0.0, None)


def test_lob_is_lowered_and_channel_is_not(spark):
    assert va.check(frame(spark, lob="AUTO")).first()["lob"] == "auto"
    assert reasons(frame(spark, lob="AUTO")) == []
    assert reasons(frame(spark, channel="direct")) == ["channel"]


@pytest.mark.parametrize("field, value", [
    ("lob", "marine"), ("channel", "Phone"), ("annual_premium", -100.0), ("annual_premium", 0.0),
    ("annual_premium", float("nan")), ("insured_age", 15), ("insured_age", 101), ("tenure_months", -1),
    ("policy_id", None), ("lob", None), ("channel", None), ("annual_premium", None),
])
def test_each_rule_rejects_alone(spark, field, value):
    assert reasons(frame(spark, **{field: value})) == [field]


def test_two_faults_are_both_named(spark):
    assert reasons(frame(spark, annual_premium=-1.0, insured_age=15)) == ["annual_premium", "insured_age"]


def test_text_input_is_typed(spark):
    text = "policy_id string, lob string, annual_premium string, tenure_months string, insured_age string, " \
           "channel string, renewal_count string, last_contact_days string"
    df = spark.createDataFrame([
        ("A", "auto", "500.5", "12", "40.0", "Direct", None, "7"),
        ("B", "auto", "five", "12.5", "40", "Direct", "x", "soon"),
    ], text)
    got = {r["policy_id"]: r for r in va.check(df).collect()}
    assert got["A"]["reasons"] == [] and got["A"]["insured_age"] == 40 and got["A"]["renewal_count"] == 0
    assert got["B"]["reasons"] == ["annual_premium", "tenure_months", "renewal_count", "last_contact_days"]


def test_null_policy(spark):
    df = frame(spark).withColumn("claim_settled_pct", F.lit(None).cast("double"))
    assert reasons(df) == []
    assert reasons(df, null_policy="reject") == ["claim_settled_pct"]
    with pytest.raises(ValueError):
        va.check(df, null_policy="ignore")


def test_split_counts(spark, five):
    bad = five.withColumn("insured_age", F.lit(10)).withColumn("channel", F.lit("Phone"))
    checked = va.check(five.unionByName(bad))
    assert va.valid_rows(checked).count() == 5 and va.rejected_rows(checked).count() == 5
    assert {r["rule"]: r["n_rejected"] for r in va.reject_counts(checked).collect()} == {
        "insured_age": 5, "channel": 5}
    assert set(REQUEST.names) <= set(checked.columns)


def test_unknown_contact(five):
    got = {r[0]: r[1] for r in va.fill_last_contact(five).select("policy_id", "last_contact_days").collect()}
    assert got["POL004"] == 90 and got["POL002"] == 200
