"""The evaluation job."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from policylens.operators.evaluation import MIN_AUC, evaluation_report, quality_gate
from policylens.operators.scoring import score
from policylens.schema import LABEL, POLICY_ID
from policylens.sources.policies import read_policies
from policylens.sources.reports import read_report, write_report
from policylens.sources.staging import scratch, stage
from policylens.sources.state import load_market_state


def eval_job(spark, policies_path, model_dir, report_path, min_auc=MIN_AUC):
    """Score a labelled table with the stored model, write the report, return the gate row."""
    model = PipelineModel.load(f"{model_dir}/model")
    state = load_market_state(spark, f"{model_dir}/market_state")
    policies = read_policies(spark, policies_path)
    with scratch(spark):
        scored = stage(
            score(policies, state, model, "calibrated").select(POLICY_ID, LABEL, F.col("churn_probability")),
            "scored")
        report = evaluation_report(scored)
        write_report(report, report_path)
    return quality_gate(read_report(spark, report_path, report.schema), min_auc)
