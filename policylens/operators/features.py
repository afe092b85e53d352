"""Market reference prices and the derived actuarial features."""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from policylens.functions.nulls import at_least, flag
from policylens.operators.ranking import grouped_quantiles
from policylens.schema import LABEL, MARKET_STATE, NON_FEATURES, POLICY_ID
from policylens.sources.staging import settled
from policylens.sources.state import empty_state

# Thresholds of the flags.
OVERPRICED_RATIO = 1.20
STRONG_INCREASE_PCT = 5
SLOW_SETTLEMENT_DAYS = 45
MIN_TENURE_YEARS = 0.1
NEW_BELOW_MONTHS = 12
LOYAL_FROM_MONTHS = 60
LONG_SILENCE_DAYS = 180
YOUNG_ADULT_AGES = (18, 30)
AGE_EDGES = [0, 25, 35, 50, 65, 100]

# The described features, in catalogue order.
FEATURE_DESCRIPTIONS = {
    "premium_to_market_ratio": "Ratio prime/médiane de la branche — signal majeur d'adéquation tarifaire",
    "is_overpriced": "1 si la prime dépasse 120 % du marché",
    "log_premium": "Prime annuelle en échelle logarithmique pour atténuer les outliers",
    "has_recent_claim": "1 si au moins un sinistre déclaré sur 12 mois",
    "multi_claim": "1 si 2 sinistres ou plus sur 12 mois (effet expérience négative)",
    "claims_per_year": "Fréquence annualisée des sinistres sur toute l'ancienneté",
    "has_unsettled_claim": "1 si un sinistre est encore en cours (proxy d'insatisfaction)",
    "slow_settlement": "1 si le délai moyen de règlement dépasse 45 jours",
    "tenure_years": "Ancienneté du contrat en années",
    "is_new_customer": "1 si l'ancienneté est < 12 mois",
    "is_loyal_customer": "1 si l'ancienneté est ≥ 5 ans",
    "never_renewed": "1 si c'est la première année du contrat",
    "is_multi_line": "1 si le client détient plusieurs contrats actifs",
    "is_young_adult": "1 si l'âge est compris entre 18 et 30 ans (forte sensibilité au prix)",
    "is_online_customer": "1 si le client a été acquis via un canal digital (churn plus élevé)",
}


def fit_market(df):
    """Exact median premium by line of business: (lob, market_median)."""
    if not {"lob", "annual_premium"} <= set(df.columns):
        return empty_state(df.sparkSession)
    known = df.select("lob", "annual_premium").where(F.col("lob").isNotNull())
    return grouped_quantiles(known, ["lob"], "annual_premium", [0.5]).withColumnRenamed(
        "q0", "market_median")


def with_market_median(df, state):
    """Left join of the fitted medians; a line that was never fitted is compared with itself."""
    fitted = state.select("lob", F.struct("market_median").alias("_fitted"))
    own = F.col("annual_premium").cast("double")
    median = F.when(F.col("_fitted").isNull(), own).otherwise(F.col("_fitted.market_median"))
    return df.join(settled(fitted), "lob", "left").select(
        *df.columns, median.alias("market_median"))


def _premium(columns):
    out = {}
    if {"annual_premium", "lob"} <= columns:
        premium = F.col("annual_premium")
        ratio = F.try_divide(premium, F.col("market_median"))
        out["premium_to_market_ratio"] = ratio
        out["is_overpriced"] = flag(ratio > OVERPRICED_RATIO)
        out["log_premium"] = F.log1p(premium)
    if "premium_change_pct" in columns:
        change = F.col("premium_change_pct")
        out["premium_increased"] = flag(change > 0)
        out["premium_increase_gt5pct"] = flag(change > STRONG_INCREASE_PCT)
    return out


def _claims(columns):
    out = {}
    if "claim_count_12m" in columns:
        recent = F.col("claim_count_12m")
        out["has_recent_claim"] = flag(recent > 0)
        out["multi_claim"] = flag(recent > 1)
    if {"claim_count_all", "tenure_months"} <= columns:
        years = at_least(F.col("tenure_months") / 12.0, MIN_TENURE_YEARS)
        out["claims_per_year"] = F.col("claim_count_all") / years
    if "claim_settled_pct" in columns:
        out["has_unsettled_claim"] = flag(F.col("claim_settled_pct") < 1.0)
    if "days_to_settle_avg" in columns:
        out["slow_settlement"] = flag(F.col("days_to_settle_avg") > SLOW_SETTLEMENT_DAYS)
    return out


def _loyalty(columns):
    out = {}
    if "tenure_months" in columns:
        months = F.col("tenure_months")
        out["tenure_years"] = months / 12.0
        out["log_tenure"] = F.log1p(months)
        out["is_new_customer"] = flag(months < NEW_BELOW_MONTHS)
        out["is_loyal_customer"] = flag(months >= LOYAL_FROM_MONTHS)
    if "renewal_count" in columns:
        renewals = F.col("renewal_count")
        out["never_renewed"] = flag(renewals == 0)
        out["log_renewals"] = F.log1p(renewals)
    if "last_contact_days" in columns:
        out["long_since_contact"] = flag(F.col("last_contact_days") > LONG_SILENCE_DAYS)
    return out


def _portfolio(columns):
    if "policy_count_active" not in columns:
        return {}
    active = F.col("policy_count_active")
    return {"is_multi_line": flag(active > 1), "multi_line_discount_eligible": flag(active >= 2)}


def age_segment(age):
    """Index of the right-closed age class, null outside all of them."""
    segment = F.lit(None).cast("int")
    for i in reversed(range(len(AGE_EDGES) - 1)):
        segment = F.when((age > AGE_EDGES[i]) & (age <= AGE_EDGES[i + 1]), i).otherwise(segment)
    return segment


def _lifecycle(columns):
    out = {}
    if "insured_age" in columns:
        age = F.col("insured_age")
        out["age_segment_encoded"] = age_segment(age)
        out["is_young_adult"] = flag(age.between(*YOUNG_ADULT_AGES))
    if "channel" in columns:
        out["is_online_customer"] = flag(F.col("channel") == "Online")
        out["is_broker_customer"] = flag(F.col("channel") == "Broker")
    return out


FEATURE_GROUPS = {
    "premium": _premium,
    "claims": _claims,
    "loyalty": _loyalty,
    "portfolio": _portfolio,
    "lifecycle": _lifecycle,
}


def derive(df, groups=tuple(FEATURE_GROUPS)):
    """Derived columns of the groups whose inputs exist; the premium group reads `market_median`."""
    columns = set(df.columns)
    derived = {}
    for name in groups:
        derived.update(FEATURE_GROUPS[name](columns))
    return df.withColumns(derived).drop("market_median")


def add_features(df, state, groups=tuple(FEATURE_GROUPS)):
    """All derived columns beside the input columns, under given medians; one row out per row in."""
    if "premium" in groups and {"annual_premium", "lob"} <= set(df.columns):
        df = with_market_median(df, state)
    return derive(df, groups)


def feature_columns(df):
    return [c for c in df.columns if c not in NON_FEATURES]


def feature_matrix(df, keep=()):
    """Model inputs only, in column order, after any columns the caller keeps beside them."""
    return df.select(*[c for c in keep if c in df.columns], *feature_columns(df))


def build_feature_matrix(df, keep=()):
    """Fit, derive and project in one go."""
    return feature_matrix(add_features(df, fit_market(df)), keep)


def training_features(df, keep=(POLICY_ID, LABEL)):
    """Feature matrix with the label beside it; the label never reaches the fit."""
    return feature_matrix(add_features(df, fit_market(df.drop(LABEL))), keep)


def inference_features(df, state, keep=(POLICY_ID,)):
    """Feature matrix under stored medians; nothing is fitted."""
    return feature_matrix(add_features(df, state), keep)


def feature_catalog(df, state):
    """Derived columns in order with description (empty where there is none), rows present and mean."""
    featured = add_features(df, state)
    derived = [c for c in featured.columns if c not in df.columns]
    facts = featured.agg(
        *[F.count(c).alias(f"_n_{c}") for c in derived],
        *[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in derived])
    return facts.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("feature"),
            F.lit(FEATURE_DESCRIPTIONS.get(c, "")).alias("description"),
            F.col(f"_n_{c}").alias("n_present"), F.col(f"_m_{c}").alias("mean"))
        for i, c in enumerate(derived)])))


class _MarketParams(Params):
    statePath = Param(Params._dummy(), "statePath", "where the table of fitted medians lies",
                      typeConverter=TypeConverters.toString)


class MarketFeatures(Estimator, _MarketParams, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage for `fit_market` and `add_features`.

    The fitted medians are written to `statePath` as a table, however many lines of business there are; the
    saved pipeline names the path.
    """

    @keyword_only
    def __init__(self, statePath=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        path = self.getOrDefault(self.statePath)
        fit_market(dataset).write.mode("overwrite").parquet(path)
        return MarketFeaturesModel(statePath=path)


class MarketFeaturesModel(Model, _MarketParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the derived columns under the stored medians."""

    @keyword_only
    def __init__(self, statePath=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def state(self, spark):
        return spark.read.schema(MARKET_STATE).parquet(self.getOrDefault(self.statePath))

    def _transform(self, dataset):
        return add_features(dataset, self.state(dataset.sparkSession))
