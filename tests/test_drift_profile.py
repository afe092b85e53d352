import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylens.functions.significance import chi_square_p, kolmogorov_p
from policylens.operators import drift, profile


def test_p_values(spark):
    df = spark.createDataFrame([(1.256463,), (1.3581,), (0.1,), (None,)], "z double")
    got = [r[0] for r in df.select(kolmogorov_p(F.col("z"))).collect()]
    assert got[:3] == pytest.approx([0.085066, 0.05, 1.0], abs=1e-5) and got[3] is None
    chi = spark.createDataFrame([(2.6497, 3), (3.841458820694124, 1), (7.814727903251179, 3), (5.991464547107979, 2),
                                 (0.0, 4), (None, 2), (1.0, 0), (5000.0, 9)], "x double, k int")
    got = [r[0] for r in chi.select(chi_square_p("x", "k")).collect()]
    assert got[:5] == pytest.approx([0.4488, 0.05, 0.05, 0.05, 1.0], abs=1e-4)
    assert got[5] is None and got[6] is None and got[7] == pytest.approx(0.0)


def test_chi_square_tail_of_many_degrees(spark):
    # The median of the distribution lies near k (1 - 2 / 9k)^3; the work must not follow the degrees.
    cases = [(k * (1 - 2 / (9 * k)) ** 3, k) for k in (3, 50, 199, 200, 201, 10_000, 10**8, 10**12)]
    df = spark.createDataFrame([(i, float(x), k) for i, (x, k) in enumerate(cases)], "i int, x double, k long")
    got = [r[0] for r in df.coalesce(1).orderBy("i").select(chi_square_p("x", "k")).collect()]
    assert got == pytest.approx([0.5] * len(cases), abs=5e-3)
    # Both sides of the change of method agree with the closed form of an even number of degrees.
    for k in (198, 200, 202):
        for x in (0.8 * k, 0.95 * k, 1.1 * k, 1.3 * k):
            closed = sum(np.exp(i * np.log(x / 2) - x / 2 - sum(np.log(np.arange(1, i + 1)))) for i in range(k // 2))
            value = spark.range(1).select(chi_square_p(F.lit(float(x)), F.lit(k))).first()[0]
            assert value == pytest.approx(closed, rel=1e-6, abs=1e-9)


def test_chi_square_tail_stays_in_the_jvm_and_ends_far_out(spark):
    df = spark.createDataFrame([(9.0, 1), (2.0, 3), (1400.0, 1), (90_000.0, 150), (90_000.0, 3000), (1e-9, 7), (1e-9, 900)], "x double, k int")
    out = df.select(chi_square_p("x", "k").alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    one, three, *far = [r["p"] for r in out.collect()]
    assert one == pytest.approx(math.erfc(math.sqrt(4.5)), rel=1e-12)
    assert three == pytest.approx(math.erfc(1.0) + 2 / math.sqrt(math.pi) * math.exp(-1.0), rel=1e-12)
    assert far == pytest.approx([0, 0, 0, 1, 1], abs=1e-12)


def test_drift_in_the_twenty_fifth_column(spark):
    df = spark.range(400).select(
        "id", *[(F.col("id") % 17).alias(f"c{i}") for i in range(30)])
    shifted = df.withColumn("c25", F.col("c25") + 100)
    found = {r["column"] for r in drift.ks_columns(df, shifted).where("drifted").collect()}
    assert found == {"c25"}


def test_nothing_in_common_is_an_empty_result(spark):
    a, b = spark.range(5).toDF("x"), spark.range(5).toDF("y")
    assert drift.ks_columns(a, b).count() == 0
    assert drift.chi2_columns(a, b).count() == 0 and drift.chi2_columns(a, b, with_p=False).count() == 0
    assert drift.drift_report(a, b).first()["share_drifted_features"] == 0.0


def brute_ks(a, b):
    grid = np.concatenate([a, b])
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    sides = []
    for n, shift in ((400, 0.0), (250, 0.4)):
        x = rng.normal(shift, 1, n)
        sides.append({"x": x, "same": rng.normal(0, 1, n), "tied": np.where(rng.random(n) < .5, 1, rng.integers(0, 4, n)),
                      "churn_label": rng.integers(0, 2, n)})
    frames = [spark.createDataFrame([tuple(map(float, t)) for t in zip(*s.values())], list(s)) for s in sides]
    holes = frames[0].withColumn("same", F.when(F.col("x") < 2, F.col("same")))
    got = {r["column"]: r for r in drift.ks_columns(holes, frames[1].drop("gone")).collect()}
    assert set(got) == {"x", "same", "tied"}
    assert got["x"]["statistic"] == pytest.approx(brute_ks(sides[0]["x"], sides[1]["x"]))
    assert got["tied"]["statistic"] == pytest.approx(brute_ks(sides[0]["tied"], sides[1]["tied"]))
    kept = sides[0]["same"][sides[0]["x"] < 2]
    assert got["same"]["statistic"] == pytest.approx(brute_ks(kept, sides[1]["same"]))
    assert got["same"]["size_ref"] == len(kept) and got["x"]["drifted"] and not got["same"]["drifted"]


def test_summary_counts_untested_columns(spark):
    tests = spark.createDataFrame([(3, "c", True), (1, "a", True), (2, "b", False)],
                                  "column_index int, column string, drifted boolean")
    row = drift.drift_summary(tests, 20).first()
    assert row["drifted_columns"] == ["a", "c"] and row["share_drifted_features"] == 0.1 and not row["alert"]
    assert drift.drift_summary(tests, 10).first()["alert"]
    none = drift.drift_summary(tests.where("false"), 0).first()
    assert none["share_drifted_features"] == 0.0 and none["drifted_columns"] == []


def test_chi2_of_equal_and_different_sides(spark):
    a = spark.createDataFrame([("x",)] * 30 + [("y",)] * 10, "lob string")
    b = spark.createDataFrame([("x",)] * 15 + [("y",)] * 25, "lob string")
    same = drift.chi2_columns(a, a).first()
    assert same["statistic"] == pytest.approx(0.0) and not same["drifted"]
    other = drift.chi2_columns(a, b).first()
    expected = sum((o - e) ** 2 / e for o, e in zip((30, 10, 15, 25), (22.5, 17.5, 22.5, 17.5)))
    assert other["statistic"] == pytest.approx(expected) and other["dof"] == 1 and other["drifted"]


def test_auc_drop_is_strict(spark):
    df = spark.createDataFrame([(0.80, 0.74), (0.75, 0.70), (0.5, 0.75)], "baseline_auc double, current_auc double")
    got = [(r["alert"], r["recommendation"]) for r in drift.auc_drift(df).collect()]
    assert got == [(True, "retrain"), (0.75 - 0.70 > 0.05, "retrain" if 0.75 - 0.70 > 0.05 else "ok"), (False, "ok")]


def test_report_row(five_labelled):
    row = drift.drift_report(five_labelled, five_labelled, timestamp="20260101_000000").first()
    assert row["share_drifted_features"] == 0.0 and not row["alert"] and row["timestamp"] == "20260101_000000"
    assert (row["n_reference"], row["n_current"]) == (5, 5)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(8)
    data = [(float(np.round(v, 1)), 7.0, int(y)) for v, y in zip(rng.normal(0, 3, 500), rng.integers(0, 2, 500))]
    df = spark.createDataFrame(data, "v double, flat double, churn_label int")
    got = {(r["column"], r["churn_label"], r["bin"]): r["n"] for r in profile.histogram_by_class(df).collect()}
    for y in (0, 1):
        counts, _ = np.histogram([d[0] for d in data if d[2] == y], bins=30)
        assert {b: n for (c, k, b), n in got.items() if c == "v" and k == y} == {
            b: n for b, n in enumerate(counts) if n}
        flat, _ = np.histogram([7.0] * sum(d[2] == y for d in data), bins=30)
        assert {b: n for (c, k, b), n in got.items() if c == "flat" and k == y} == {
            b: n for b, n in enumerate(flat) if n}


def test_describe_and_correlation_equal_pandas(spark, five_labelled):
    pandas = five_labelled.toPandas()
    numeric = pandas.select_dtypes("number")
    want = numeric.describe()
    for row in profile.describe(five_labelled).collect():
        stats = want[row["column"]]
        assert [row["count"], row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]] \
            == pytest.approx(list(stats), nan_ok=True)
    corr = numeric.drop(columns="churn_label").corr()
    got = profile.correlation_matrix(five_labelled).collect()
    assert len(got) == 55
    for row in got:
        value = corr.loc[row["row_feature"], row["column_feature"]]
        assert (row["correlation"] is None) == bool(np.isnan(value))
        if row["correlation"] is not None:
            assert row["correlation"] == pytest.approx(value)
    flat = five_labelled.withColumn("flat", F.lit(1.0))
    last = profile.correlation_with_label(flat, ["flat", "annual_premium"]).collect()[-1]
    assert last["feature"] == "flat" and last["correlation"] is None


def test_null_profile(five_labelled):
    got = {r["column"]: (r["n_rows"], r["n_non_null"], r["dtype"]) for r in profile.null_profile(five_labelled).collect()}
    assert got["last_contact_days"] == (5, 4, "int") and got["lob"] == (5, 5, "string")
    assert profile.head_rows(five_labelled, 2).count() == 2
