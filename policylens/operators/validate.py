"""Record validation as a table job: defaults, normalisation, rules, valid and rejected rows."""

from pyspark.sql import functions as F

from policylens.schema import CHANNELS, LOBS, REQUEST

# Defaults of the optional fields and the stand-in for an unknown last contact.
DEFAULTS = {
    "renewal_count": 0,
    "claim_count_12m": 0,
    "claim_count_all": 0,
    "claim_settled_pct": 1.0,
    "days_to_settle_avg": 30.0,
    "policy_count_active": 1,
    "premium_change_pct": 0.0,
    "last_contact_days": None,
}
UNKNOWN_CONTACT_DAYS = 90
NULLABLE = {"last_contact_days"}

# Inclusive bounds by field; the premium bound is exclusive.
BOUNDS = {
    "annual_premium": (0, None),
    "tenure_months": (0, None),
    "renewal_count": (0, None),
    "claim_count_12m": (0, None),
    "claim_count_all": (0, None),
    "claim_settled_pct": (0, 1),
    "days_to_settle_avg": (0, None),
    "insured_age": (18, 100),
    "policy_count_active": (1, None),
}
OPEN_BELOW = {"annual_premium"}
DOMAINS = {"lob": LOBS, "channel": CHANNELS}


def normalize_lob(df):
    return df.withColumn("lob", F.lower("lob"))


def fill_last_contact(df, days=UNKNOWN_CONTACT_DAYS):
    """Scoring only: an unknown last contact counts as `days` ago."""
    if "last_contact_days" not in df.columns:
        return df.withColumn("last_contact_days", F.lit(days))
    return df.withColumn("last_contact_days", F.coalesce("last_contact_days", F.lit(days)))


def apply_defaults(df, null_policy="default"):
    """Give every optional field a value.

    An absent column gets its default. A null cell gets it too under `null_policy="default"` and is
    left for the rules to reject under "reject".
    """
    if null_policy not in ("default", "reject"):
        raise ValueError(f"null_policy must be 'default' or 'reject', not {null_policy!r}")
    types = {f.name: f.dataType for f in REQUEST.fields}
    filled = {}
    for name, value in DEFAULTS.items():
        default = F.lit(value).cast(types[name])
        if name not in df.columns:
            filled[name] = default
        elif null_policy == "default" and value is not None:
            filled[name] = F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
    return df.withColumns(filled) if filled else df


def _typed(df):
    """Each field in its declared type beside the text it came as; what does not parse becomes null."""
    columns = []
    for field in REQUEST.fields:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.dataType.simpleString() == "int":
            number = F.col(field.name).try_cast("double")
            whole = F.when(~F.isnan(number) & (number == F.floor(number)), number)
            columns.append(whole.try_cast("int").alias(field.name))
        else:
            columns.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in REQUEST.names]
    given = [
        (F.col(c).isNotNull() if c in df.columns else F.lit(False)).alias(f"_given_{c}")
        for c in sorted(NULLABLE)
    ]
    return df.select(*columns, *extra, *given)


def _field_fault(field):
    """Condition under which a typed field breaks its rule."""
    value = F.col(field.name)
    if field.name in NULLABLE:
        return F.col(f"_given_{field.name}") & value.isNull()
    checks = [value.isNotNull()]
    if field.name in DOMAINS:
        checks.append(value.isin(DOMAINS[field.name]))
    if field.dataType.simpleString() == "double":
        checks.append(~F.isnan(value))
    low, high = BOUNDS.get(field.name, (None, None))
    if low is not None:
        checks.append(value > low if field.name in OPEN_BELOW else value >= low)
    if high is not None:
        checks.append(value <= high)
    passed = checks[0]
    for check in checks[1:]:
        passed = passed & check
    return ~F.coalesce(passed, F.lit(False))


def check(df, null_policy="default"):
    """Normalised records with `reasons`: the names of the fields that break a rule, in schema order."""
    typed = _typed(apply_defaults(normalize_lob(df), null_policy))
    faults = F.array(*[
        F.when(_field_fault(field), F.lit(field.name)) for field in REQUEST.fields])
    return (
        typed.withColumn("reasons", F.array_compact(faults))
        .drop(*[f"_given_{c}" for c in NULLABLE])
    )


def valid_rows(checked):
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected_rows(checked):
    return checked.where(F.size("reasons") > 0)


def reject_counts(checked):
    """Rejected rows by broken rule; a row with two faults counts under both."""
    return (
        checked.select(F.explode("reasons").alias("rule"))
        .groupBy("rule").agg(F.count(F.lit(1)).alias("n_rejected"))
    )
