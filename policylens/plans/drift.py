"""The monitoring job."""

from policylens.operators.drift import auc_drift, drift_report
from policylens.operators.evaluation import curve_metrics, score_curve
from policylens.sources.policies import read_policies
from policylens.sources.reports import read_report, write_report
from policylens.sources.staging import scratch


def drift_job(spark, reference_path, current_path, out_path, scorer=None, timestamp=None):
    """Compare two stored policy tables; write `drift` and, given a scorer, `auc` as JSON. Returns (drift, auc).

    `scorer` adds `churn_probability`. The performance part needs labels on both sides.
    """
    sides = [read_policies(spark, path) for path in (reference_path, current_path)]
    with scratch(spark):
        report = drift_report(*sides, timestamp=timestamp)
        write_report(report, f"{out_path}/drift")
        report = read_report(spark, f"{out_path}/drift", report.schema)
        if scorer is None:
            return report, None
        baseline, current = (
            curve_metrics(score_curve(scorer(side))).first()["auc"] for side in sides)
    compared = auc_drift(spark.createDataFrame(
        [(baseline, current)], "baseline_auc double, current_auc double"))
    write_report(compared, f"{out_path}/auc")
    return report, compared
