import numpy as np
import pytest
from pyspark.sql import functions as F

from policylens.operators import evaluation as ev

P_MIXED = [.9, .7, .3, .2, .1, .8, .4, .15, .05, .25]


def scored(spark, y, p):
    rows = [(f"P{i:03d}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "policy_id string, churn_label int, churn_probability double")


def metrics(df):
    return ev.curve_metrics(ev.score_curve(df)).first()


def brute_auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    gaps = p[y == 1][:, None] - p[y == 0][None, :]
    return ((gaps > 0) + 0.5 * (gaps == 0)).mean()


def brute_ap(y, p):
    y, p = np.asarray(y), np.asarray(p)
    total, last = 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        recall = y[p >= cut].sum() / y.sum()
        total += (recall - last) * y[p >= cut].mean()
        last = recall
    return total


def test_golden_mixed_and_imperfect(spark):
    mixed = scored(spark, [1, 1, 0, 0, 0, 1, 0, 0, 0, 0], P_MIXED)
    assert metrics(mixed)["auc"] == 1.0 and metrics(mixed)["avg_precision"] == pytest.approx(1.0)
    assert ev.brier(mixed).first()["brier"] == pytest.approx(0.05275)
    imperfect = metrics(scored(spark, [1, 0, 1, 0, 0, 1, 0, 0, 0, 0], P_MIXED))
    assert imperfect["auc"] == pytest.approx(19 / 21)
    assert imperfect["avg_precision"] == pytest.approx(0.866667, abs=1e-6)


def test_one_class_has_no_auc(spark):
    none = metrics(scored(spark, [0] * 5, [.5, .4, .3, .2, .1]))
    assert none["auc"] is None and none["avg_precision"] is None
    every = metrics(scored(spark, [1] * 3, [.5, .4, .3]))
    assert every["auc"] is None and every["avg_precision"] == 1.0


def test_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(700), 2)
    p[::3] = 0.37
    y = (rng.random(700) < p * 0.6).astype(int)
    df = scored(spark, y, p)
    assert metrics(df)["auc"] == pytest.approx(brute_auc(y, p))
    assert metrics(df)["avg_precision"] == pytest.approx(brute_ap(y, p))
    stretched = df.withColumn("churn_probability", F.exp("churn_probability") / 3)
    assert metrics(stretched)["auc"] == pytest.approx(metrics(df.repartition(17))["auc"], abs=1e-15)


def test_metrics_by_model(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    parts, want = [], {}
    for name in ("a", "b", "c"):
        p = np.round(rng.random(300) * 0.5 + y * 0.2, 2)
        parts.append(scored(spark, y, p).withColumn("model", F.lit(name)))
        want[name] = (brute_auc(y, p), brute_ap(y, p), float(np.mean((p - y) ** 2)))
    got = ev.model_comparison(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()
    assert {r["model"]: pytest.approx((r["auc"], r["avg_precision"], r["brier"])) for r in got} == want


def test_topk_golden(spark):
    perfect = scored(spark, [1, 1, 1] + [0] * 7, [.9, .8, .7] + [.1] * 7)
    got = {r["top_k"]: r for r in ev.topk_metrics(perfect, [0.30, 0.15, 0.10]).collect()}
    assert (got[0.3]["precision"], got[0.3]["recall"], got[0.3]["lift"]) == (1.0, 1.0, 3.33)
    for f in (0.15, 0.10):
        assert (got[f]["precision"], got[f]["recall"], got[f]["lift"]) == (1.0, 0.3333, 3.33)
        assert (got[f]["churners_captured"], got[f]["total_churners"]) == (1, 3)


def test_topk_without_positives_or_rows(spark):
    none = ev.topk_metrics(scored(spark, [0] * 5, [.5, .4, .3, .2, .1]), [0.15]).first()
    assert tuple(none)[:3] == (0.0, 0.0, 0.0) and none["total_churners"] == 0


def test_topk_size_in_doubles(spark):
    df = scored(spark, [0, 1] * 50, [i / 100 for i in range(100)])
    assert ev.captured_at(df, [0.29]).first()["k"] == int(100 * 0.29) == 28


def test_topk_cuts_inside_a_tie_by_id(spark):
    df = scored(spark, [0, 1, 1, 0, 0, 1], [.5] * 6)
    got = [r["captured"] for r in ev.captured_at(df, [1 / 6 + 1e-9, 2 / 6 + 1e-9, 0.5, 1.0]).orderBy("k").collect()]
    assert got == [0, 1, 2, 3]


def test_topk_with_repeated_ids_keeps_its_size(spark):
    df = scored(spark, [1, 0, 1, 0], [.5] * 4).withColumn("policy_id", F.lit("same"))
    assert ev.captured_at(df, [0.5]).first()["captured"] == 2


def test_gains_and_roc(spark):
    df = scored(spark, [1, 0, 1, 0, 0, 1, 0, 0, 0, 0], P_MIXED)
    curve = ev.gains_curve(df).orderBy("rn").collect()
    assert [r["share_captured"] for r in curve][:4] == pytest.approx([1 / 3, 2 / 3, 2 / 3, 2 / 3])
    assert curve[-1]["share_captured"] == 1.0 and curve[-1]["share_contacted"] == 1.0
    points = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(ev.score_curve(df)).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and len(points) == 11
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(19 / 21)


def test_calibration_edges(spark):
    edges = [0.0, 0.1, 0.100001, 0.2, 0.5, 1.0]
    got = {r["bin"]: r["n"] for r in ev.calibration_table(scored(spark, [0] * 6, edges)).collect()}
    assert got == {0: 2, 1: 2, 4: 1, 9: 1}


def test_report_and_gate(spark):
    report = ev.evaluation_report(scored(spark, [1, 0, 1, 0, 0, 1, 0, 0, 0, 0], P_MIXED))
    values = {(r["section"], r["metric"]): r["value"] for r in report.collect()}
    assert values["overall", "auc_roc"] == 0.9048 and values["overall", "avg_precision"] == 0.8667
    assert {s for s, _ in values} == {"overall", "business_metrics_10pct", "business_metrics_15pct"}
    assert len(values) == 15
    assert ev.quality_gate(report).first()["passed"] is True
    assert ev.quality_gate(report, 0.95).first()["passed"] is False
