"""The feature job."""

from policylens.operators.features import training_features
from policylens.sources.policies import read_policies, write_table


def build_training_features(spark, policies_path, out_path=None):
    """Feature matrix of a labelled table, with id and label beside it; stored if a path is given."""
    matrix = training_features(read_policies(spark, policies_path))
    if out_path is None:
        return matrix
    write_table(matrix, out_path)
    return spark.read.schema(matrix.schema).parquet(out_path)
