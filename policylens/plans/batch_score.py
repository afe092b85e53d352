"""The batch scoring job."""

from pyspark.ml import PipelineModel

from policylens.operators.scoring import batch_result, score
from policylens.sources.policies import read_policies, write_table
from policylens.sources.state import load_market_state


def batch_score(spark, policies_path, out_path, model_dir=None, model=None, state=None):
    """Read, score, write; model and medians come from `model_dir` unless given. Returns the stored table."""
    model = model or PipelineModel.load(f"{model_dir}/model")
    state = state if state is not None else load_market_state(spark, f"{model_dir}/market_state")
    scored = score(read_policies(spark, policies_path, labelled=False), state, model, "calibrated")
    result = batch_result(scored)
    write_table(result, out_path)
    return spark.read.schema(result.schema).parquet(out_path)
