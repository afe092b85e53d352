"""Persisted fitted state: the market medians."""

import logging

from pyspark.errors import AnalysisException

from policylens.schema import MARKET_STATE

log = logging.getLogger(__name__)


def empty_state(spark):
    return spark.createDataFrame([], MARKET_STATE)


def save_market_state(state, path):
    state.write.mode("overwrite").parquet(path)
    return path


def load_market_state(spark, path):
    """Stored medians; without them an empty state, under which every price ratio is 1."""
    try:
        return spark.read.schema(MARKET_STATE).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        log.warning("no market state at %s: every premium_to_market_ratio will be 1", path)
        return empty_state(spark)
