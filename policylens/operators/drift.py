"""Data drift between two tables and performance drift between two AUCs."""

from pyspark.sql import functions as F

from policylens.functions.significance import chi_square_p, kolmogorov_p
from policylens.operators.profile import column_name, melt
from policylens.operators.ranking import prefix_sums
from policylens.schema import LABEL, numeric_columns
from policylens.sources.staging import stage

# Significance, alert thresholds, number of features on a card and the name of the method.
P_DRIFT = 0.05
SHARE_ALERT = 0.15
DATASET_SHARE = 0.5
AUC_DROP_ALERT = 0.05
CARD_FEATURES = 10
METHOD = "ks_test_fallback"

CATEGORIES = ("lob", "channel", LABEL)


def _side_counts(reference, current, columns, cast):
    """Rows of either side per (column, value); missing values are left out."""
    sides = [
        melt(side, columns, cast=cast).where(F.col("value").isNotNull()).select(
            "*", F.lit(ref).alias("_ref"), F.lit(1 - ref).alias("_cur"))
        for side, ref in ((reference, 1), (current, 0))
    ]
    return sides[0].unionByName(sides[1]).groupBy("column_index", "value").agg(
        F.sum("_ref").alias("n_ref"), F.sum("_cur").alias("n_cur"))


TESTS = "column_index int, column string, size_ref bigint, size_cur bigint, statistic double, p_value double, drifted boolean"


def ks_columns(reference, current, target=LABEL):
    """Two-sample Kolmogorov-Smirnov per numeric column of the reference that `current` has too.

    Both samples are reduced to counts per distinct value before any order is made. The p-value is that of
    the limit series at every size. Tables with nothing in common give an empty result.
    """
    tested = [c for c in numeric_columns(reference, exclude=[target]) if c in current.columns]
    if not tested:
        return reference.sparkSession.createDataFrame([], TESTS)
    counts = _side_counts(reference, current, tested, "double")
    running = prefix_sums(
        stage(counts, "counts"), ["value"], {"cum_ref": "n_ref", "cum_cur": "n_cur"}, ["column_index"],
        {"size_ref": "cum_ref", "size_cur": "cum_cur"}, few_groups=True)
    gap = F.abs(
        F.try_divide(F.col("cum_ref"), F.col("size_ref").cast("double"))
        - F.try_divide(F.col("cum_cur"), F.col("size_cur").cast("double")))
    n, m = F.col("size_ref").cast("double"), F.col("size_cur").cast("double")
    tested_columns = (
        running.groupBy("column_index", "size_ref", "size_cur")
        .agg(F.max(gap).alias("statistic"))
        .withColumn("_z", F.sqrt(F.try_divide(n * m, n + m)) * F.col("statistic"))
        .withColumn("p_value", kolmogorov_p(F.col("_z")))
    )
    return tested_columns.select(
        "column_index", column_name(tested), "size_ref", "size_cur", "statistic", "p_value",
        F.coalesce(F.col("p_value") < P_DRIFT, F.lit(False)).alias("drifted"))


def drift_summary(tests, n_numeric, threshold=SHARE_ALERT):
    """One row: share of drifted among all numeric columns (not only the tested), their names, alert."""
    hits = F.sort_array(F.collect_list(
        F.when(F.col("drifted"), F.struct("column_index", "column"))))
    return (
        tests.agg(hits.alias("_hits"))
        .select(
            F.lit(METHOD).alias("method"),
            (F.size("_hits") / F.lit(float(max(n_numeric, 1)))).alias("share_drifted_features"),
            F.transform("_hits", lambda hit: hit["column"]).alias("drifted_columns"))
        .withColumn("alert", F.col("share_drifted_features") > threshold)
        .withColumn("dataset_drift_detected", F.col("alert"))
    )


def chi2_columns(reference, current, columns=CATEGORIES, with_p=True):
    """Pearson chi-square of side against category per column.

    With a_j rows of category j on the reference side and n_j on both, the statistic of a table of
    two rows is N^2 / (A (N - A)) * (sum a_j^2 / n_j - A^2 / N): sums only, in one aggregate.
    """
    present = [c for c in columns if c in reference.columns and c in current.columns]
    if not present:
        schema = "column_index int, column string, statistic double, dof int"
        return reference.sparkSession.createDataFrame([], schema + (", p_value double, drifted boolean" if with_p else ""))
    a = F.col("n_ref").cast("double")
    n = (F.col("n_ref") + F.col("n_cur")).cast("double")
    sums = (
        _side_counts(reference, current, present, "string")
        .groupBy("column_index")
        .agg(F.sum(a).alias("_a"), F.sum(n).alias("_n"), F.sum(a * a / n).alias("_s"),
             (F.count(F.lit(1)) - 1).cast("int").alias("dof")))
    total, ours = F.col("_n"), F.col("_a")
    spread = F.greatest(F.lit(0.0), F.col("_s") - ours * ours / total)
    statistic = F.try_divide(total * total, ours * (total - ours)) * spread
    tests = sums.select("column_index", column_name(present), statistic.alias("statistic"), "dof")
    if not with_p:
        return tests
    return (
        tests.withColumn("p_value", chi_square_p("statistic", "dof"))
        .withColumn("drifted", F.coalesce(F.col("p_value") < P_DRIFT, F.lit(False)))
    )


def drift_report(reference, current, target=LABEL, categories=CATEGORIES, timestamp=None):
    """One row over every numeric column and the categories: share drifted, flags, both sizes."""
    ks = ks_columns(reference, current, target)
    chi2 = chi2_columns(reference, current, categories)
    tests = ks.select("column", "drifted").unionByName(chi2.select("column", "drifted"))
    share = F.try_divide(F.sum(F.col("drifted").cast("int")), F.count(F.lit(1)).cast("double"))
    summary = tests.agg(F.coalesce(share, F.lit(0.0)).alias("share_drifted_features"))
    stamp = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    sizes = reference.select(F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionAll(
        current.select(F.lit(0).alias("_r"), F.lit(1).alias("_c"))
    ).agg(F.coalesce(F.sum("_r"), F.lit(0)).alias("n_reference"),
          F.coalesce(F.sum("_c"), F.lit(0)).alias("n_current"))
    parts = [
        summary.select("share_drifted_features", F.lit(None).cast("long").alias("n_reference"), F.lit(None).cast("long").alias("n_current")),
        sizes.select(F.lit(None).cast("double").alias("share_drifted_features"), "n_reference", "n_current")]
    joined = parts[0].unionAll(parts[1]).agg(*[F.max(c).alias(c) for c in parts[0].columns])
    return joined.select(
        stamp.alias("timestamp"),
        "share_drifted_features",
        (F.col("share_drifted_features") >= DATASET_SHARE).alias("dataset_drift_detected"),
        (F.col("share_drifted_features") > SHARE_ALERT).alias("alert"),
        "n_reference", "n_current")


def auc_drift(aucs, threshold=AUC_DROP_ALERT):
    """Drop from baseline to current AUC per row, with alert and recommendation."""
    drop = F.col("baseline_auc") - F.col("current_auc")
    alert = drop > threshold
    return aucs.select(
        "*", drop.alias("auc_drop"), alert.alias("alert"),
        F.when(alert, "retrain").otherwise("ok").alias("recommendation"))


def model_card_facts(train, test, metrics, importance, label=LABEL, top=CARD_FEATURES):
    """(section, position, name, value): data sizes, performance and the leading features.

    `metrics` is (name, value) and `importance` is (feature, value); both are small tables.
    """
    sizes = train.select(F.lit(1).alias("_t"), label).unionAll(test.select(F.lit(0).alias("_t"), label)).agg(
        F.sum("_t").cast("double").alias("n_train"),
        F.sum(1 - F.col("_t")).cast("double").alias("n_test"),
        F.avg(label).alias("positive_rate"))
    data = sizes.select(F.lit("data").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).alias("value"))
        for i, c in enumerate(sizes.columns)])))
    shown = ["auc_roc", "precision_at_10", "recall", "f1"]
    place = F.array_position(F.array(*map(F.lit, shown)), F.col("name")).cast("int") - 1
    performance = metrics.where(F.col("name").isin(shown)).select(
        F.lit("performance").alias("section"), place.alias("position"), "name", "value")
    leading = importance.orderBy(F.desc("value"), "feature").limit(top)
    features = leading.agg(F.sort_array(F.collect_list(
        F.struct((-F.col("value")).alias("_v"), F.col("feature")))).alias("_f")).select(
        F.lit("features").alias("section"), F.posexplode("_f").alias("position", "_f")).select(
        "section", "position", F.col("_f.feature").alias("name"), (-F.col("_f._v")).alias("value"))
    return data.unionByName(performance).unionByName(features)
