"""The given tables as raw contracts, policy records and scored records.

Raw contracts, policies, medians and scores are stored once per session and folder, as delivery,
ingest and scoring would leave them, and the queries read the stored tables.
"""

import os

from pyspark.sql import functions as F

from policylens.functions.noise import ModularNoise
from policylens.operators.features import fit_market
from policylens.operators.translate import translate
from policylens.schema import LABEL, RAW_COLUMNS, RAW_TARGET
from policylens.sources.staging import stage

PRODUCT_OF_PART = {
    "PPERSAUT": "ECONOMY", "PBRAND": "LARGE", "PWAPART": "MEDIUM", "PLEVEN": "PROMO", "PMOTSCO": "SMALL",
}
URGENT = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
PURCHASING_POWER = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}

_stored = {}


def stored(spark, sf_dir, name, build):
    """The stored table of this name, built on first use in this session."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _stored:
        _stored[key] = stage(build(spark, sf_dir), name)
    return _stored[key]


def forget():
    """Build every table anew on next use."""
    _stored.clear()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_raw_contracts(spark, sf_dir):
    """One row per customer: classes and counts over the customer's orders and lines.

    Lines that no count can take are left out before they meet the parts; the others are counted per order before they meet
    the orders, and per customer after that. An order without such lines counts as 0.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    returned, large = F.col("l_returnflag") == "R", F.col("l_quantity") >= 30
    counts = {column: large & (F.col("p_type") == part_type) for column, part_type in PRODUCT_OF_PART.items()}
    # Whole percent by bounds: rounding a double goes through decimals and would be most of the scan.
    counts["AWAPART"] = returned & (F.col("l_discount") * 100 >= 9.5) & (F.col("l_discount") * 100 < 10.5)
    counts["APERSAUT"] = returned & (F.col("l_tax") * 100 >= 7.5) & (F.col("l_tax") * 100 < 8.5)
    lines = lines.where(large | counts["AWAPART"] | counts["APERSAUT"])
    per_order = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey").agg(*[F.count_if(c).alias(name) for name, c in counts.items()]))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    per_customer = (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey").agg(
            *[F.sum(name).alias(name) for name in counts],
            F.count_if(F.col("o_orderpriority").isin(URGENT)).alias("MAANTHUI")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")

    power = F.lit(5)
    for segment, level in PURCHASING_POWER.items():
        power = F.when(F.col("c_mktsegment") == segment, level).otherwise(power)
    known = {name: F.coalesce(F.col(name), F.lit(0)) for name in [*counts, "MAANTHUI"]}
    rooms = F.least(F.lit(10), known["MAANTHUI"])
    claims = F.least(F.lit(10), known["AWAPART"] + known["APERSAUT"])
    target = (F.col("c_custkey") * 7919) % 100 + claims * 5 - rooms * 4 > 78
    return joined.select(
        F.col("c_custkey").alias("client_no"),
        *[F.least(F.lit(9), known[c]).cast("int").alias(c) for c in PRODUCT_OF_PART],
        *[known[c].cast("int").alias(c) for c in ("AWAPART", "APERSAUT")],
        rooms.cast("int").alias("MAANTHUI"),
        (F.col("c_nationkey") % 6 + 1).cast("int").alias("MGEMLEEF"),
        power.alias("MKOOPKLA"),
        target.cast("int").alias(RAW_TARGET),
    )


def raw_contracts(spark, sf_dir):
    return stored(spark, sf_dir, "raw_contracts", build_raw_contracts)


def contract_lines(raw, columns=RAW_COLUMNS):
    """All file columns in file order, the ones the tables do not give as 0."""
    return raw.orderBy("client_no").select(*[
        F.col(c) if c in raw.columns else F.lit(0).alias(c) for c in columns])


def write_lines(df, path):
    df.write.option("sep", "\t").csv(path)
    return path


def build_policies(spark, sf_dir):
    return translate(raw_contracts(spark, sf_dir), "client_no", noise=ModularNoise())


def policies(spark, sf_dir):
    return stored(spark, sf_dir, "policies", build_policies)


def market_state(spark, sf_dir):
    return stored(spark, sf_dir, "market_state", lambda s, d: fit_market(policies(s, d)))


def client_no():
    return F.substring("policy_id", 4, 30).cast("long")


def scorecard(df, name="churn_probability"):
    """A fixed linear score through the logistic function, to 6 decimals."""
    z = (
        F.lit(-2.5) + 0.6 * F.col("claim_count_12m") - 0.07 * (F.col("tenure_months") - 36)
        + 0.03 * F.col("premium_change_pct"))
    return df.withColumn(name, F.round(1.0 / (1.0 + F.exp(-z)), 6))


SCORECARD_WEIGHTS = {"claim_count_12m": 0.6, "tenure_months": -0.07, "premium_change_pct": 0.03}

DERIVED_WEIGHTS = {"premium_to_market_ratio": 0.8, "tenure_years": -0.3, "has_recent_claim": 0.5}


def tenure_card(df, name="churn_probability"):
    """A second score that knows only the tenure."""
    z = 0.1 * (30.0 - F.col("tenure_months"))
    return df.withColumn(name, F.round(1.0 / (1.0 + F.exp(-z)), 6))


def scores(spark, sf_dir):
    return stored(spark, sf_dir, "scores", lambda s, d: scorecard(policies(s, d)))


def requests(spark, sf_dir):
    return policies(spark, sf_dir).drop(LABEL)


def dirty_requests(spark, sf_dir):
    """Requests with one fault, or none or two, by customer number."""
    case = F.col("client_no") % 20
    df = requests(spark, sf_dir).withColumn("client_no", client_no())

    def where(cases, value, column):
        return F.when(case.isin(cases), value).otherwise(F.col(column)).alias(column)

    changed = {
        "policy_id": where([8], F.lit(None), "policy_id"),
        "lob": F.when(case == 0, "MARINE").when(case == 1, F.upper("lob")).otherwise(F.col("lob")).alias("lob"),
        "annual_premium": F.when(case.isin(3, 9), -F.col("annual_premium"))
        .when(case == 10, F.lit(float("nan"))).otherwise(F.col("annual_premium")).alias("annual_premium"),
        "insured_age": where([4, 9], F.lit(15), "insured_age"),
        "channel": where([2], F.lit("Phone"), "channel"),
        "claim_settled_pct": where([6], F.lit(1.5), "claim_settled_pct"),
        "policy_count_active": where([7], F.lit(0), "policy_count_active"),
        "last_contact_days": where([5], F.lit(None).cast("int"), "last_contact_days"),
    }
    return df.select(*[changed.get(c, F.col(c)) for c in df.columns])


# Texts that come in place of a field, by customer number modulo 30: wrong types, fractions, and every bound from outside.
TYPED_FAULTS = [
    ("annual_premium", "abc"), ("annual_premium", "0"), ("tenure_months", "-1"), ("tenure_months", "12.5"), ("renewal_count", "x"),
    ("renewal_count", "-2"), ("claim_count_12m", "-1"), ("claim_count_all", "-3"), ("claim_settled_pct", "1.01"),
    ("claim_settled_pct", "-0.1"), ("days_to_settle_avg", "-5"), ("insured_age", "17"), ("insured_age", "101"),
    ("policy_count_active", "0"), ("last_contact_days", "soon"), ("insured_age", "18.0"), ("premium_change_pct", "NaN"),
    ("channel", "Phone"), ("lob", "MARINE"), ("claim_count_12m", "1e0"), ("policy_id", None), ("annual_premium", None),
    ("tenure_months", "99999999999"), ("claim_settled_pct", "0.5.1"),
]


def texted_requests(spark, sf_dir):
    """Requests whose fields all come as text, some of them wrong."""
    df = requests(spark, sf_dir).withColumn("client_no", client_no())
    changed = {}
    for name in df.columns[:-1]:
        value = F.col(name).cast("string")
        for case, (field, text) in enumerate(TYPED_FAULTS):
            if field == name:
                value = F.when(F.col("client_no") % 30 == case, F.lit(text).cast("string")).otherwise(value)
        changed[name] = value
    return df.withColumns(changed)


def sparse_requests(spark, sf_dir):
    """Requests without two optional columns and with missing cells in two others."""
    df = requests(spark, sf_dir).withColumn("client_no", client_no())
    return (
        df.drop("days_to_settle_avg", "renewal_count")
        .withColumn("claim_settled_pct", F.when(F.col("client_no") % 3 != 0, F.col("claim_settled_pct")))
        .withColumn("policy_count_active", F.when(F.col("client_no") % 4 != 0, F.col("policy_count_active")))
        .withColumn("last_contact_days", F.when(F.col("client_no") % 5 != 0, F.col("last_contact_days")))
    )


def repeated_requests(spark, sf_dir):
    """Scored requests, some asked again later with twice the premium."""
    first = scores(spark, sf_dir).withColumn("pos", client_no())
    again = (
        first.where(F.col("pos") % 50 == 0)
        .withColumn("annual_premium", F.col("annual_premium") * 2)
        .withColumn("pos", F.col("pos") + 1_000_000_000))
    return first.unionByName(again)


def drift_sides(spark, sf_dir, condition):
    df = policies(spark, sf_dir)
    return df.where(condition), df.where(~condition)


def line_scores(spark, sf_dir, fine=False):
    """Every order line as a scored record: few distinct scores, or nearly one per line."""
    p = F.col("l_extendedprice") / 105000.0 if fine else F.col("l_discount") * 5.0 + F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.floor(p * 1e6 + 0.5) / 1e6).alias("churn_probability"),
        (F.col("l_returnflag") == "R").cast("int").alias(LABEL))


LINE_KEY = ("l_orderkey", "l_linenumber")
