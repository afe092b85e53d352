"""Data profiles: counts, moments, quartiles, histograms, correlations, rates."""

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policylens.operators.ranking import grouped_quantiles
from policylens.schema import LABEL, POLICY_ID, numeric_columns

HISTOGRAM_BINS = 30


def melt(df, columns, keep=(), cast="double"):
    """(keep, column_index, value), one row per cell of the columns.

    Cells carry the number of their column only; `column_name` gives the name back after aggregation.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("column_index"), F.col(c).cast(cast).alias("value"))
        for i, c in enumerate(columns)])
    return df.select(*keep, F.inline(cells))


def column_name(columns, index="column_index"):
    return F.get(F.array(*map(F.lit, columns)), F.col(index)).alias("column")


def null_profile(df):
    """Type, row count and non-null count of every column, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_{c}") for c in df.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("column_index"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col("_rows").alias("n_rows"), F.col(f"_{f.name}").alias("n_non_null"))
        for i, f in enumerate(df.schema.fields)])))


def head_rows(df, n=5, order_by=(POLICY_ID,)):
    return df.orderBy(*order_by).limit(n)


def describe(df, columns=None):
    """count, mean, sample deviation, min, quartiles and max of each numeric column."""
    columns = columns or numeric_columns(df)
    cells = melt(df, columns).where(F.col("value").isNotNull())
    moments = cells.groupBy("column_index").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = grouped_quantiles(
        cells, ["column_index"], "value", [0.25, 0.5, 0.75], few_groups=True)
    return moments.join(quartiles, "column_index").select(
        "column_index", column_name(columns), "count", "mean", "std", "min",
        F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def target_distribution(df, label=LABEL):
    """Rows and share of each class, most frequent first."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))).cast("double")
    return counts.withColumn("share", share).orderBy(F.desc("n"), label)


def histogram_by_class(df, columns=None, label=LABEL, n_bins=HISTOGRAM_BINS):
    """Equal-width bin counts per column and class over the class's own range; empty bins are absent.

    The last bin is closed on both sides. A constant column spans half a unit either way.
    """
    columns = columns or numeric_columns(df, exclude=[label])
    classes = df.where(F.col(label).isin(0, 1))
    ranges = classes.groupBy(label).agg(
        *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in columns],
    ).select(label, F.inline(F.array(*[
        F.struct(F.lit(i).alias("column_index"), F.col(f"_lo_{c}").alias("_lo"), F.col(f"_hi_{c}").alias("_hi"))
        for i, c in enumerate(columns)])))
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.select(
        label, "column_index",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))

    low, high, v = F.col("_lo"), F.col("_hi"), F.col("value")
    width = (high - low) / float(n_bins)
    guess = F.least(F.lit(n_bins - 1), F.floor((v - low) / width).cast("int"))
    # The division can land one bin off; the edges themselves decide.
    settled = (
        F.when((F.col("_g") > 0) & (v < low + F.col("_g") * width), F.col("_g") - 1)
        .when((F.col("_g") < n_bins - 1) & (v >= low + (F.col("_g") + 1) * width), F.col("_g") + 1)
        .otherwise(F.col("_g")))
    # At most two classes times the chosen columns on the broadcast side.
    return (
        melt(classes, columns, keep=[label]).where(v.isNotNull())
        .join(F.broadcast(ranges), [label, "column_index"])
        .withColumn("_g", guess).withColumn("bin", settled)
        .groupBy("column_index", label, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("range_low"), F.max("_hi").alias("range_high"))
        .select("column_index", column_name(columns), label, "bin", "n", "range_low", "range_high")
    )


def _correlations(df, pairs):
    """(pair, x, y, correlation) for (x, y) column pairs, null where either side is constant.

    Each pair uses the rows that have both values. Pairs are laid out as rows: a row of `df` yields
    one cell per pair, and the cells are summed up per pair before anything is shuffled. That is a
    third of the time of one aggregate with a few functions per pair.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        for i, (a, b) in enumerate(pairs)])
    spread = F.sqrt(F.regr_sxx("a", "b")) * F.sqrt(F.regr_syy("a", "b"))
    sums = df.select(F.inline(cells)).groupBy("pair").agg(
        F.try_divide(F.regr_sxy("a", "b"), spread).alias("correlation"))
    first, second = (F.array(*[F.lit(pair[side]) for pair in pairs]) for side in (0, 1))
    return sums.select(
        "pair", F.get(first, "pair").alias("x"), F.get(second, "pair").alias("y"), "correlation")


def correlation_matrix(df, columns=None, label=LABEL):
    """Strict lower triangle of the Pearson matrix: (row_feature, column_feature, correlation)."""
    columns = columns or numeric_columns(df, exclude=[label])
    return _correlations(df, [(b, a) for a, b in combinations(columns, 2)]).select(
        F.col("x").alias("row_feature"), F.col("y").alias("column_feature"), "correlation")


def correlation_with_label(df, columns, label=LABEL):
    """Correlation of each column with the label, highest first, undefined ones last."""
    return (
        _correlations(df, [(c, label) for c in columns])
        .select(F.col("x").alias("feature"), "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "feature")
    )


def rate_by(df, category, label=LABEL):
    """Label rate by category, highest first."""
    return (
        df.where(F.col(category).isNotNull()).groupBy(category)
        .agg(F.avg(label).alias("rate"), F.count(label).alias("n"))
        .orderBy(F.desc("rate"), category)
    )


def premium_tenure_grid(df, label=LABEL, tenure_width=12, premium_width=100.0):
    """Rows per class in cells of premium and tenure, named by their lower corner."""
    tenure = (F.floor(F.col("tenure_months") / F.lit(tenure_width)) * tenure_width).cast("int")
    premium = F.floor(F.col("annual_premium") / F.lit(premium_width)) * F.lit(premium_width)
    return (
        df.groupBy(label, tenure.alias("tenure_from"), premium.alias("premium_from"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def market_medians(state):
    return state.orderBy("lob")
