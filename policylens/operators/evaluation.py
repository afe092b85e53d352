"""Ranking and calibration metrics of scored, labelled tables.

Everything is built on two small intermediates: totals from one aggregate, and the score curve, which
has one row per distinct score. Rows themselves are shuffled only for the full gains curve.
"""

from functools import reduce

from pyspark.sql import functions as F

from policylens.functions.rounding import round_half_even
from policylens.operators.ranking import (
    at_or_before, keys_at_ranks, parse_order, prefix_sums, same_key,
)
from policylens.schema import LABEL, POLICY_ID
from policylens.sources.staging import settled, stage

SCORE = "churn_probability"
REPORT_FRACTIONS = (0.10, 0.15)
LIFT_FRACTIONS = (0.10, 0.15, 0.20, 0.50, 1.00)
CALIBRATION_BINS = 10
MIN_AUC = 0.70


def score_curve(df, label=LABEL, score=SCORE, by=()):
    """One row per distinct score: rows and positives there, from the top down to there, and in all."""
    distinct = df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return prefix_sums(stage(distinct, "scores"), [(score, "desc")], {"cum_n": "n", "cum_pos": "pos"}, by,
                       {"all_n": "cum_n", "all_pos": "cum_pos"})


def curve_metrics(curve, by=()):
    """AUC with ties at half weight and the step-sum average precision, null if a class is absent."""
    negatives = (F.col("n") - F.col("pos")).cast("double")
    pairs = negatives * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))
    steps = F.col("pos") * (F.col("cum_pos") / F.col("cum_n"))
    sums = curve.groupBy(*by).agg(
        F.sum("pos").alias("_p"), F.sum(negatives).alias("_q"),
        F.sum(pairs).alias("_pairs"), F.sum(steps).alias("_steps"))
    return sums.select(
        *by,
        F.try_divide(F.col("_pairs"), F.col("_p") * F.col("_q")).alias("auc"),
        F.try_divide(F.col("_steps"), F.col("_p").cast("double")).alias("avg_precision"),
    )


def roc_points(curve, score=SCORE):
    """(threshold, fpr, tpr) per distinct score, from (0, 0) at no threshold on."""
    positives = F.col("all_pos").cast("double")
    negatives = (F.col("all_n") - F.col("all_pos")).cast("double")
    points = curve.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_n") - F.col("cum_pos"), negatives).alias("fpr"),
        F.try_divide(F.col("cum_pos"), positives).alias("tpr"),
    )
    start = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def brier(df, label=LABEL, score=SCORE, by=()):
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


def _ranked_order(score, ids):
    return [(score, "desc"), *ids]


def captured_at(df, fractions, label=LABEL, score=SCORE, ids=(POLICY_ID,)):
    """Positives among the first floor(n * f) rows for each fraction, with the totals.

    Ties on the score are ordered by `ids`. The cut keys are found by counting passes; then one
    aggregate counts the positives on or before each of them.
    """
    order_by = _ranked_order(score, ids)
    order = parse_order(order_by)
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).first()
    n, positives = totals["n"], totals["pos"] or 0
    sizes = [int(n * f) for f in fractions]
    cuts = keys_at_ranks(df, order_by, sizes, n)
    wanted = []
    for i, size in enumerate(sizes):
        if size == 0:
            before, at = F.lit(False), F.lit(False)
        else:
            at = same_key(order, cuts[size].key)
            before = at_or_before(order, cuts[size].key) & ~at
        hit = F.col(label).cast("long")
        wanted.append(F.coalesce(F.sum(F.when(before, hit)), F.lit(0)).alias(f"before{i}"))
        wanted.append(F.coalesce(F.sum(F.when(at, hit)), F.lit(0)).alias(f"at{i}"))
    rows = []
    for i, (fraction, size) in enumerate(zip(fractions, sizes)):
        room = size - cuts[size].rows_before if size else 0
        rows.append(F.struct(
            F.lit(float(fraction)).alias("top_k"),
            F.lit(size).cast("long").alias("k"),
            (F.col(f"before{i}") + F.least(F.col(f"at{i}"), F.lit(room))).alias("captured"),
            F.lit(positives).cast("long").alias("positives"),
            F.lit(n).cast("long").alias("n"),
        ))
    return df.agg(*wanted).select(F.inline(F.array(*rows)))


def topk_metrics(df, fractions, label=LABEL, score=SCORE, ids=(POLICY_ID,)):
    """Precision, recall and lift of contacting the top fraction; 0 where undefined."""
    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    precision = ratio(F.col("captured"), F.col("k"))
    recall = ratio(F.col("captured"), F.col("positives"))
    lift = ratio(precision, ratio(F.col("positives"), F.col("n")))
    return captured_at(df, fractions, label, score, ids).select(
        round_half_even(precision, 4).alias("precision"),
        round_half_even(recall, 4).alias("recall"),
        round_half_even(lift, 2).alias("lift"),
        "top_k",
        F.col("captured").alias("churners_captured"),
        F.col("positives").alias("total_churners"),
    )


def gains_curve(df, label=LABEL, score=SCORE, ids=(POLICY_ID,)):
    """One row per customer from the highest score down: share contacted and share of positives found."""
    order_by = _ranked_order(score, ids)
    marked = df.select(score, *ids, F.col(label).cast("long").alias("_hit"), F.lit(1).alias("_one"))
    curve = prefix_sums(marked, order_by, {"rn": "_one", "found": "_hit"}, totals={"n": "rn", "pos": "found"})
    return curve.select(
        *ids, "rn",
        (F.col("rn") / F.col("n").cast("double")).alias("share_contacted"),
        F.try_divide(F.col("found"), F.col("pos").cast("double")).alias("share_captured"),
    )


def lift_table(df, fractions=LIFT_FRACTIONS, label=LABEL, score=SCORE, ids=(POLICY_ID,)):
    """The gains curve at fixed fractions: share contacted, share captured, lift over random."""
    captured = F.try_divide(F.col("captured"), F.col("positives").cast("double"))
    contacted = F.try_divide(F.col("k"), F.col("n").cast("double"))
    return captured_at(df, fractions, label, score, ids).select(
        "top_k", "k", "captured", captured.alias("share_captured"),
        F.try_divide(captured, contacted).alias("lift"))


def calibration_table(df, label=LABEL, score=SCORE, n_bins=CALIBRATION_BINS):
    """Mean score and positive share per non-empty uniform bin; an edge belongs to the bin below it."""
    p = F.col(score)
    bin_no = reduce(
        lambda acc, i: acc + (p > F.lit(i * (1.0 / n_bins))).cast("int"), range(1, n_bins), F.lit(0))
    return (
        df.where(p.isNotNull()).groupBy(bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"),
             F.avg(label).alias("fraction_positive"))
    )


def model_comparison(df, label=LABEL, score=SCORE, by=("model",)):
    """AUC, average precision and Brier score for each model in a long score table."""
    ranking = curve_metrics(score_curve(df, label, score, by), by)
    return ranking.join(settled(brier(df, label, score, by)), list(by))


def evaluation_report(df, label=LABEL, score=SCORE, ids=(POLICY_ID,), fractions=REPORT_FRACTIONS):
    """Long report (section, metric, value): overall metrics to 4 decimals and the top-k blocks."""
    overall = (
        curve_metrics(score_curve(df, label, score))
        .unionByName(brier(df, label, score), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("auc", "avg_precision", "brier")])
    )
    names = {"auc": "auc_roc", "avg_precision": "avg_precision", "brier": "brier_score"}
    overall = overall.select(F.inline(F.array(*[
        F.struct(F.lit("overall").alias("section"), F.lit(metric).alias("metric"),
                 round_half_even(F.col(c), 4).alias("value"))
        for c, metric in names.items()])))
    block = F.format_string("business_metrics_%dpct", F.round(F.col("top_k") * 100).cast("int"))
    metrics = ["precision", "recall", "lift", "top_k", "churners_captured", "total_churners"]
    blocks = topk_metrics(df, fractions, label, score, ids).select(
        block.alias("section"),
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics])))
    return overall.unionByName(blocks)


def quality_gate(report, min_auc=MIN_AUC):
    """One row: the rounded AUC, the threshold and whether the model passes."""
    return report.where((F.col("section") == "overall") & (F.col("metric") == "auc_roc")).select(
        F.col("value").alias("auc_roc"),
        F.lit(float(min_auc)).alias("min_auc"),
        F.coalesce(F.col("value") >= min_auc, F.lit(False)).alias("passed"),
    )
