"""Raw contract classes to policy records: one projection, no shuffle."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from policylens.functions.noise import HashedNoise
from policylens.functions.nulls import at_least, at_most
from policylens.schema import (
    CHANNELS, EUR_PER_CLASS, LOB_DRIVERS, MIN_PREMIUM, NOT_A_PRODUCT, RAW_TARGET,
)


def policy_id(number, id_offset=0):
    """POL and at least seven digits; longer numbers keep all of theirs."""
    return F.format_string("POL%07d", (number + id_offset).cast("long"))


def dominant_lob():
    """Line with the largest contribution; the earlier line wins a tie, no signal means the first."""
    known = [F.coalesce(F.col(c), F.lit(0)) for c in LOB_DRIVERS.values()]
    amounts, total = F.array(*known), reduce(add, known)
    position = F.array_position(amounts, F.array_max(amounts)).cast("int")
    names = list(LOB_DRIVERS)
    return F.when(total == 0, names[0]).otherwise(
        F.element_at(F.array(*map(F.lit, names)), position))


def annual_premium(columns):
    """Euros by class over the product columns at hand, never below the minimum premium."""
    terms = [F.col(c) * float(eur) for c, eur in EUR_PER_CLASS.items() if c in columns]
    return at_least(reduce(add, terms, F.lit(0.0)), MIN_PREMIUM)


def insured_age(age_class):
    midpoint = at_most(at_least(age_class, 1), 6) * 10 + 15
    return at_most(at_least(midpoint, 18), 100)


def channel(purchasing_power):
    slot = F.pmod(F.coalesce(purchasing_power, F.lit(0)), F.lit(len(CHANNELS)))
    return F.element_at(F.array(*map(F.lit, CHANNELS)), slot.cast("int") + 1)


def active_policies(columns):
    """Number of product columns in use, at least 1."""
    products = [c for c in columns if c.startswith("P") and c not in NOT_A_PRODUCT]
    held = reduce(add, [F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in products], F.lit(0))
    return F.greatest(held, F.lit(1))


def translate(raw, key, seed=42, id_offset=0, noise=None):
    """Policy records from raw contracts.

    `key` names the row number (a source key or `with_row_number`); it feeds the policy id and the
    noise. Two datasets get disjoint ids from disjoint ranges of key + `id_offset`.
    """
    noise = noise or HashedNoise(seed)
    number = F.col(key)
    columns = [c for c in raw.columns if c != key]

    tenure = F.greatest(F.col("MAANTHUI"), F.lit(1)) * 6 + noise.tenure_jitter(number)
    base = raw.select(
        "*",
        at_least(F.when(F.col("MAANTHUI").isNotNull(), tenure), 0).cast("int").alias("_tenure"),
        F.least(
            F.lit(10), F.coalesce("AWAPART", F.lit(0)) + F.coalesce("APERSAUT", F.lit(0)),
        ).cast("int").alias("_claims"),
    )
    tenure, claims = F.col("_tenure"), F.col("_claims")
    record = [
        policy_id(number, id_offset).alias("policy_id"),
        dominant_lob().alias("lob"),
        annual_premium(columns).alias("annual_premium"),
        tenure.alias("tenure_months"),
        F.floor(tenure / 12).cast("int").alias("renewal_count"),
        claims.alias("claim_count_12m"),
        (claims + F.floor(tenure / 24).cast("int")).alias("claim_count_all"),
        F.greatest(F.lit(0.4), F.least(F.lit(1.0), 1.0 - 0.05 * claims)).alias("claim_settled_pct"),
        (25.0 + 5.0 * claims).alias("days_to_settle_avg"),
        insured_age(F.col("MGEMLEEF")).cast("int").alias("insured_age"),
        channel(F.col("MKOOPKLA")).alias("channel"),
        active_policies(columns).alias("policy_count_active"),
        noise.premium_change(number).alias("premium_change_pct"),
        (tenure % 90 + noise.contact_jitter(number)).cast("int").alias("last_contact_days"),
    ]
    if RAW_TARGET in columns:
        record.append(F.col(RAW_TARGET).cast("int").alias("churn_label"))
    return base.select(*record)
