"""One missing-value contract: NaN becomes null at the source, flags are never null."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df):
    """Replace NaN by null in every floating-point column."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def flag(condition):
    """0/1 integer; missing input counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def at_least(column, bound):
    """Lower clip that leaves missing values missing."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(bound)))


def at_most(column, bound):
    """Upper clip that leaves missing values missing."""
    return F.when(column.isNotNull(), F.least(column, F.lit(bound)))
