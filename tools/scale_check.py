"""Time the ordering operators on many rows with a hot score and a hot line of business.

usage: python tools/scale_check.py [rows in millions] [folder]

Derives the rows with Spark: a third share one score, half share one line, and the other scores are
nearly all different.
"""

import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from policylens.operators import drift, evaluation, features, profile, ranking, scoring  # noqa: E402
from policylens.session import local_session  # noqa: E402
from policylens.sources.staging import remove_intermediate  # noqa: E402


def rows(spark, n):
    k = F.col("id")
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    other = F.element_at(F.array(*map(F.lit, ("home", "health", "liability"))), (k % 3 + 1).cast("int"))
    return spark.range(0, n, 1, 32).select(
        F.format_string("POL%010d", k).alias("policy_id"),
        F.when(k % 3 == 0, F.lit(0.5)).otherwise(unit).alias("churn_probability"),
        (unit * unit > 0.9).cast("int").alias("churn_label"),
        F.when(k % 2 == 0, "auto").otherwise(other).alias("lob"),
        F.round(unit * 2000, 2).alias("annual_premium"),
        (k % 90).cast("int").alias("tenure_months"))


def main():
    millions = float(sys.argv[1]) if len(sys.argv) > 1 else 5
    folder = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="scale-")
    spark = local_session(app="scale")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    path = os.path.join(folder, "rows")
    rows(spark, int(millions * 1_000_000)).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    order = [("churn_probability", "desc"), "policy_id"]
    jobs = {
        "scan": lambda: df.agg(F.sum("churn_probability"), F.max("policy_id")),
        "features and tiers": lambda: scoring.batch_result(features.add_features(df, features.fit_market(df))),
        "top-k cuts": lambda: evaluation.captured_at(df, [0.1, 0.15, 0.5]),
        "ordered split": lambda: ranking.split_ordered(df).groupBy("part").count(),
        "global rank": lambda: ranking.global_rank(df.select("policy_id", "churn_probability"), order),
        "AUC": lambda: evaluation.curve_metrics(evaluation.score_curve(df)),
        "gains curve": lambda: evaluation.gains_curve(df),
        "median by line": lambda: features.fit_market(df),
        "median by line, built in": lambda: df.groupBy("lob").agg(F.median("annual_premium")),
        "median of scores by line": lambda: ranking.grouped_quantiles(df, ["lob"], "churn_probability", [0.5]),
        "median of scores by line, built in": lambda: df.groupBy("lob").agg(F.median("churn_probability")),
        "correlations": lambda: profile.correlation_matrix(df),
        "Kolmogorov-Smirnov": lambda: drift.ks_columns(df.where("lob = 'auto'"), df.where("lob <> 'auto'")),
    }
    for name, job in jobs.items():
        started = time.perf_counter()
        job().write.mode("overwrite").format("noop").save()
        print(f"{name:36} {time.perf_counter() - started:8.1f} s", flush=True)
    remove_intermediate(spark)
    spark.stop()


if __name__ == "__main__":
    main()
