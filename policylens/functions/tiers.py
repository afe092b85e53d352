"""Risk tiers and retention actions."""

from pyspark.sql import functions as F

# Upper tier edges and the action for each tier, from lowest risk to highest.
TIERS = ["low", "medium", "high", "critical"]
TIER_EDGES = [0.20, 0.45, 0.70]
TOP_EDGE = 1.0
ACTIONS = {
    "low": "no_action",
    "medium": "soft_retention",
    "high": "proactive_outreach",
    "critical": "urgent_retention",
}
AT_RISK = ["high", "critical"]


def risk_tier(p, closed):
    """Tier of a probability.

    `closed="right"` is the batch rule: an edge belongs to the tier below it and values outside
    [0, 1] have no tier. `closed="left"` is the online rule: an edge belongs to the tier above it
    and whatever lies outside [0, 0.70) is critical.
    """
    low, medium, high = TIER_EDGES
    if closed == "right":
        return (
            F.when(p.between(0.0, low), "low")
            .when((p > low) & (p <= medium), "medium")
            .when((p > medium) & (p <= high), "high")
            .when((p > high) & (p <= TOP_EDGE), "critical")
        )
    if closed == "left":
        return (
            F.when((p >= 0.0) & (p < low), "low")
            .when((p >= low) & (p < medium), "medium")
            .when((p >= medium) & (p < high), "high")
            .otherwise("critical")
        )
    raise ValueError(f"closed must be 'left' or 'right', not {closed!r}")


def tier_rank(tier):
    """Position of a tier from 0 (low) to 3 (critical), for ordering."""
    return F.when(tier.isNotNull(), F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int") - 1)


def retention_action(tier):
    chain = F
    for name, action in ACTIONS.items():
        chain = chain.when(tier == name, action)
    return chain
