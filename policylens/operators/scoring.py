"""Scores to tiers, actions and portfolio totals. A scorer is any DataFrame -> DataFrame function
that adds `churn_probability`; batch and stream use the same one."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from policylens.functions.rounding import round_half_even
from policylens.functions.tiers import AT_RISK, retention_action, risk_tier, tier_rank
from policylens.functions.value import lifetime_value
from policylens.operators.features import add_features
from policylens.operators.validate import fill_last_contact
from policylens.schema import POLICY_ID

SCORE = "churn_probability"


def score(df, state, model, probability="probability"):
    """Positive-class probability beside the input columns.

    `model` is a fitted pipeline over the derived features, which fills those that are missing with the
    medians it has learnt; every row gets a score.
    """
    featured = add_features(fill_last_contact(df), state)
    scored = model.transform(featured)
    return scored.select(*df.columns, vector_to_array(probability)[1].alias(SCORE))


def batch_result(scored, rank=False):
    """(policy_id if there is one, probability, batch tier)."""
    tier = risk_tier(F.col(SCORE), closed="right")
    columns = [c for c in (POLICY_ID,) if c in scored.columns]
    columns += [SCORE, tier.alias("risk_tier")]
    if rank:
        columns.append(tier_rank(tier).alias("tier_rank"))
    return scored.select(*columns)


def prediction_rows(scored, model_name, stage):
    """The online answer per policy; the tier comes from the unrounded probability."""
    tier = risk_tier(F.col(SCORE), closed="left")
    return scored.select(
        POLICY_ID,
        round_half_even(F.col(SCORE), 4).alias(SCORE),
        tier.alias("risk_tier"),
        retention_action(tier).alias("recommended_action"),
        lifetime_value(F.col("annual_premium"), F.col("tenure_months")).alias("estimated_clv"),
        F.lit(f"{model_name}@{stage}").alias("model_version"),
    )


def at_risk_by_policy(requests, position="pos"):
    """(policy_id, rows at risk, premium of the first request by `position`) for each policy, in one aggregate."""
    at_risk = risk_tier(F.col(SCORE), closed="left").isin(AT_RISK)
    return requests.groupBy(POLICY_ID).agg(
        F.sum(at_risk.cast("long")).alias("rows_at_risk"),
        F.min_by("annual_premium", position).alias("first_premium"))


def at_risk_total(per_policy):
    """Rows at risk and their premiums over all policies, in one row."""
    return per_policy.agg(
        F.coalesce(F.sum("rows_at_risk"), F.lit(0)).alias("total_at_risk"),
        round_half_even(F.coalesce(F.sum(F.col("rows_at_risk") * F.col("first_premium")), F.lit(0.0)), 2)
        .alias("total_premium_at_risk"),
    )


def at_risk_summary(requests, position="pos"):
    """Rows at risk and their premiums, in one row.

    A repeated policy id always counts with the premium of its first request. One aggregate per id
    gives both the number of its rows at risk and that premium, so nothing is joined.
    """
    return at_risk_total(at_risk_by_policy(requests, position))
