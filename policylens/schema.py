"""Record layouts and the fixed values the computations depend on."""

from pyspark.sql import types as T

# The 86 column names of the raw contract file, in file order.
RAW_COLUMNS = [
    "MOSTYPE", "MAANTHUI", "MGEMOMV", "MGEMLEEF", "MOSHOOFD", "MGODRK", "MGODPR", "MGODOV", "MGODGE", "MRELGE",
    "MRELSA", "MRELOV", "MFALLEEN", "MFGEKIND", "MFWEKIND", "MOPLHOOG", "MOPLMIDD", "MOPLLAAG", "MBERHOOG",
    "MBERZELF", "MBERBOER", "MBERMIDD", "MBERARBG", "MBERARBO", "MSKA", "MSKB1", "MSKB2", "MSKC", "MSKD",
    "MHHUUR", "MHKOOP", "MAUT1", "MAUT2", "MAUT0", "MZFONDS", "MZPART", "MINKM30", "MINK3045", "MINK4575",
    "MINK7512", "MINK123M", "MINKGEM", "MKOOPKLA", "PWAPART", "PWABEDR", "PWALAND", "PPERSAUT", "PBESAUT",
    "PMOTSCO", "PVRAAUT", "PAANHANG", "PTRACTOR", "PWERKT", "PBROM", "PLEVEN", "PPERSONG", "PGEZONG", "PWAOREG",
    "PBRAND", "PZEILPL", "PPLEZIER", "PFIETS", "PINBOED", "PBYSTAND", "AWAPART", "AWABEDR", "AWALAND",
    "APERSAUT", "ABESAUT", "AMOTSCO", "AVRAAUT", "AAANHANG", "ATRACTOR", "AWERKT", "ABROM", "ALEVEN",
    "APERSONG", "AGEZONG", "AWAOREG", "ABRAND", "AZEILPL", "APLEZIER", "AFIETS", "AINBOED", "ABYSTAND",
    "CARAVAN",
]
RAW_TARGET = "CARAVAN"

# Product column that stands for each line of business; ties go to the earlier line.
LOB_DRIVERS = {"auto": "PPERSAUT", "home": "PBRAND", "liability": "PWAPART", "health": "PLEVEN"}

# Euros per contribution class.
EUR_PER_CLASS = {"PPERSAUT": 120, "PBRAND": 80, "PWAPART": 60, "PLEVEN": 90, "PMOTSCO": 50}
MIN_PREMIUM = 50.0

# Domains of the categorical fields.
LOBS = ["auto", "home", "liability", "health"]
CHANNELS = ["Direct", "Broker", "Online", "Agent"]

# A product column by its name prefix, but no product.
NOT_A_PRODUCT = {"PWERKT"}

LABEL = "churn_label"
POLICY_ID = "policy_id"

POLICY = T.StructType([
    T.StructField("policy_id", T.StringType()),
    T.StructField("lob", T.StringType()),
    T.StructField("annual_premium", T.DoubleType()),
    T.StructField("tenure_months", T.IntegerType()),
    T.StructField("renewal_count", T.IntegerType()),
    T.StructField("claim_count_12m", T.IntegerType()),
    T.StructField("claim_count_all", T.IntegerType()),
    T.StructField("claim_settled_pct", T.DoubleType()),
    T.StructField("days_to_settle_avg", T.DoubleType()),
    T.StructField("insured_age", T.IntegerType()),
    T.StructField("channel", T.StringType()),
    T.StructField("policy_count_active", T.IntegerType()),
    T.StructField("premium_change_pct", T.DoubleType()),
    T.StructField("last_contact_days", T.IntegerType()),
    T.StructField("churn_label", T.IntegerType()),
])
REQUEST = T.StructType([f for f in POLICY.fields if f.name != LABEL])

MARKET_STATE = T.StructType([
    T.StructField("lob", T.StringType()),
    T.StructField("market_median", T.DoubleType()),
])

RUN_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

# Columns that never enter the feature matrix.
NON_FEATURES = [
    "policy_id", "customer_id", "inception_date", "expiry_date", "lob", "region", "channel",
    "churn_label",
]


def raw_schema(with_target=True):
    names = RAW_COLUMNS if with_target else [c for c in RAW_COLUMNS if c != RAW_TARGET]
    return T.StructType([T.StructField(c, T.IntegerType()) for c in names])


def numeric_columns(df, exclude=()):
    """Numeric column names of `df` in schema order."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
