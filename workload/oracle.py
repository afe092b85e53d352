"""The registered queries in DuckDB SQL over the given tables, written independently of the Spark code."""

from policylens.operators.features import FEATURE_DESCRIPTIONS
from policylens.schema import RAW_COLUMNS

RAW = """
li AS (
  SELECT o_custkey AS k,
    count(*) FILTER (WHERE l_quantity >= 30 AND p_type = 'ECONOMY') AS n_auto,
    count(*) FILTER (WHERE l_quantity >= 30 AND p_type = 'LARGE') AS n_home,
    count(*) FILTER (WHERE l_quantity >= 30 AND p_type = 'MEDIUM') AS n_liab,
    count(*) FILTER (WHERE l_quantity >= 30 AND p_type = 'PROMO') AS n_life,
    count(*) FILTER (WHERE l_quantity >= 30 AND p_type = 'SMALL') AS n_moped,
    count(*) FILTER (WHERE l_returnflag = 'R' AND round(l_discount * 100) = 10) AS n_aw,
    count(*) FILTER (WHERE l_returnflag = 'R' AND round(l_tax * 100) = 8) AS n_ap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey),
oc AS (
  SELECT o_custkey AS k,
    count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS n_rooms
  FROM orders GROUP BY o_custkey),
raw0 AS (
  SELECT c_custkey AS client_no,
    CAST(least(9, coalesce(n_auto, 0)) AS INTEGER) AS PPERSAUT,
    CAST(least(9, coalesce(n_home, 0)) AS INTEGER) AS PBRAND,
    CAST(least(9, coalesce(n_liab, 0)) AS INTEGER) AS PWAPART,
    CAST(least(9, coalesce(n_life, 0)) AS INTEGER) AS PLEVEN,
    CAST(least(9, coalesce(n_moped, 0)) AS INTEGER) AS PMOTSCO,
    CAST(coalesce(n_aw, 0) AS INTEGER) AS AWAPART,
    CAST(coalesce(n_ap, 0) AS INTEGER) AS APERSAUT,
    CAST(least(10, coalesce(n_rooms, 0)) AS INTEGER) AS MAANTHUI,
    CAST(1 + c_nationkey % 6 AS INTEGER) AS MGEMLEEF,
    CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
      WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS INTEGER) AS MKOOPKLA
  FROM customer LEFT JOIN li ON c_custkey = li.k LEFT JOIN oc ON c_custkey = oc.k),
raw AS (
  SELECT *, CAST(CASE WHEN (client_no * 7919) % 100 + 5 * least(10, AWAPART + APERSAUT)
    - 4 * MAANTHUI > 78 THEN 1 ELSE 0 END AS INTEGER) AS CARAVAN
  FROM raw0)"""

POLICIES = RAW + """,
pre AS (
  SELECT *,
    CAST(greatest(1, MAANTHUI) * 6 + (client_no * 31 + 42) % 6 AS INTEGER) AS t,
    CAST(least(10, AWAPART + APERSAUT) AS INTEGER) AS cl
  FROM raw),
policies AS (
  SELECT client_no,
    printf('POL%07d', client_no) AS policy_id,
    CASE WHEN PPERSAUT + PBRAND + PWAPART + PLEVEN = 0 THEN 'auto'
      WHEN PPERSAUT >= greatest(PBRAND, PWAPART, PLEVEN) THEN 'auto'
      WHEN PBRAND >= greatest(PWAPART, PLEVEN) THEN 'home'
      WHEN PWAPART >= PLEVEN THEN 'liability' ELSE 'health' END AS lob,
    CAST(greatest(50, 120 * PPERSAUT + 80 * PBRAND + 60 * PWAPART + 90 * PLEVEN + 50 * PMOTSCO)
      AS DOUBLE) AS annual_premium,
    t AS tenure_months,
    CAST(t // 12 AS INTEGER) AS renewal_count,
    cl AS claim_count_12m,
    CAST(cl + t // 24 AS INTEGER) AS claim_count_all,
    greatest(CAST(0.4 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) - CAST(0.05 AS DOUBLE) * cl))
      AS claim_settled_pct,
    CAST(25 + 5 * cl AS DOUBLE) AS days_to_settle_avg,
    CAST(least(100, greatest(18, least(6, greatest(1, MGEMLEEF)) * 10 + 15)) AS INTEGER) AS insured_age,
    CASE MKOOPKLA % 4 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Broker' WHEN 2 THEN 'Online' ELSE 'Agent' END
      AS channel,
    CAST(greatest(1, (PPERSAUT > 0)::INT + (PBRAND > 0)::INT + (PWAPART > 0)::INT + (PLEVEN > 0)::INT
      + (PMOTSCO > 0)::INT) AS INTEGER) AS policy_count_active,
    CAST((client_no * 17 + 42) % 201 - 80 AS DOUBLE) / CAST(10 AS DOUBLE) AS premium_change_pct,
    CAST(t % 90 + 10 + (client_no * 13 + 42) % 50 AS INTEGER) AS last_contact_days,
    CARAVAN AS churn_label
  FROM pre)"""

STATE = POLICIES + """,
state AS (SELECT lob, median(annual_premium) AS market_median FROM policies GROUP BY lob)"""

FEATURES_OF = """
  SELECT p.*,
    annual_premium / coalesce(market_median, annual_premium) AS premium_to_market_ratio,
    (annual_premium / coalesce(market_median, annual_premium) > CAST(1.2 AS DOUBLE))::INT AS is_overpriced,
    ln(CAST(1 AS DOUBLE) + annual_premium) AS log_premium,
    (premium_change_pct > 0)::INT AS premium_increased,
    (premium_change_pct > 5)::INT AS premium_increase_gt5pct,
    (claim_count_12m > 0)::INT AS has_recent_claim,
    (claim_count_12m > 1)::INT AS multi_claim,
    claim_count_all / greatest(tenure_months / CAST(12 AS DOUBLE), CAST(0.1 AS DOUBLE)) AS claims_per_year,
    (claim_settled_pct < 1)::INT AS has_unsettled_claim,
    (days_to_settle_avg > 45)::INT AS slow_settlement,
    tenure_months / CAST(12 AS DOUBLE) AS tenure_years,
    ln(CAST(1 + tenure_months AS DOUBLE)) AS log_tenure,
    (tenure_months < 12)::INT AS is_new_customer,
    (tenure_months >= 60)::INT AS is_loyal_customer,
    (renewal_count = 0)::INT AS never_renewed,
    ln(CAST(1 + renewal_count AS DOUBLE)) AS log_renewals,
    (last_contact_days > 180)::INT AS long_since_contact,
    (policy_count_active > 1)::INT AS is_multi_line,
    (policy_count_active >= 2)::INT AS multi_line_discount_eligible,
    CASE WHEN insured_age > 0 AND insured_age <= 25 THEN 0 WHEN insured_age > 25 AND insured_age <= 35 THEN 1
      WHEN insured_age > 35 AND insured_age <= 50 THEN 2 WHEN insured_age > 50 AND insured_age <= 65 THEN 3
      WHEN insured_age > 65 AND insured_age <= 100 THEN 4 END AS age_segment_encoded,
    (insured_age BETWEEN 18 AND 30)::INT AS is_young_adult,
    (channel = 'Online')::INT AS is_online_customer,
    (channel = 'Broker')::INT AS is_broker_customer
  FROM policies p LEFT JOIN state s ON p.lob = s.lob"""

FEATURES = STATE + ",\nfeatures AS (" + FEATURES_OF + ")"

SCORES = POLICIES + """,
scores AS (
  SELECT *, round(CAST(1 AS DOUBLE) / (1 + exp(-(CAST(-2.5 AS DOUBLE)
    + CAST(0.6 AS DOUBLE) * claim_count_12m - CAST(0.07 AS DOUBLE) * (tenure_months - 36)
    + CAST(0.03 AS DOUBLE) * premium_change_pct))), 6) AS churn_probability
  FROM policies)"""

TENURE_CARD = """round(CAST(1 AS DOUBLE) / (1 + exp(-(CAST(0.1 AS DOUBLE) * (30 - tenure_months)))), 6)"""

LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber,
    round(l_discount * CAST(5 AS DOUBLE) + l_tax, 6) AS churn_probability,
    (l_returnflag = 'R')::INT AS churn_label
  FROM lineitem)"""

FINE_LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber,
    round(l_extendedprice / CAST(105000 AS DOUBLE), 6) AS churn_probability,
    (l_returnflag = 'R')::INT AS churn_label
  FROM lineitem)"""

DIRTY = POLICIES + """,
dirty AS (
  SELECT client_no,
    CASE WHEN client_no % 20 = 8 THEN NULL ELSE policy_id END AS policy_id,
    CASE client_no % 20 WHEN 0 THEN 'MARINE' WHEN 1 THEN upper(lob) ELSE lob END AS lob,
    CASE WHEN client_no % 20 IN (3, 9) THEN -annual_premium WHEN client_no % 20 = 10 THEN 'NaN'::DOUBLE
      ELSE annual_premium END AS annual_premium,
    tenure_months, claim_count_12m, premium_change_pct,
    CASE WHEN client_no % 20 IN (4, 9) THEN 15 ELSE insured_age END AS insured_age,
    CASE WHEN client_no % 20 = 2 THEN 'Phone' ELSE channel END AS channel,
    CASE WHEN client_no % 20 = 6 THEN CAST(1.5 AS DOUBLE) ELSE claim_settled_pct END AS claim_settled_pct,
    CASE WHEN client_no % 20 = 7 THEN 0 ELSE policy_count_active END AS policy_count_active,
    CASE WHEN client_no % 20 = 5 THEN NULL ELSE last_contact_days END AS last_contact_days
  FROM policies),
faults AS (
  SELECT client_no, u.rule AS rule, u.pos AS pos FROM (
    SELECT client_no, unnest([
      {'pos': 1, 'rule': 'policy_id', 'bad': policy_id IS NULL},
      {'pos': 2, 'rule': 'lob', 'bad': lower(lob) NOT IN ('auto', 'home', 'liability', 'health')},
      {'pos': 3, 'rule': 'annual_premium', 'bad': isnan(annual_premium) OR annual_premium <= 0},
      {'pos': 4, 'rule': 'claim_settled_pct', 'bad': claim_settled_pct < 0 OR claim_settled_pct > 1},
      {'pos': 5, 'rule': 'insured_age', 'bad': insured_age < 18 OR insured_age > 100},
      {'pos': 6, 'rule': 'channel', 'bad': channel NOT IN ('Direct', 'Broker', 'Online', 'Agent')},
      {'pos': 7, 'rule': 'policy_count_active', 'bad': policy_count_active < 1}]) AS u
    FROM dirty) WHERE u.bad)"""

SPARSE = POLICIES + """,
sparse AS (
  SELECT policy_id, lob, annual_premium, tenure_months, claim_count_12m, claim_count_all,
    CASE WHEN client_no % 3 <> 0 THEN claim_settled_pct END AS claim_settled_pct,
    insured_age, channel,
    CASE WHEN client_no % 4 <> 0 THEN policy_count_active END AS policy_count_active,
    premium_change_pct,
    CASE WHEN client_no % 5 <> 0 THEN last_contact_days END AS last_contact_days,
    client_no
  FROM policies)"""

# Every field as text, by the customer number's remainder some of them wrong.
TEXTED_FIELDS = {
    "policy_id": "WHEN 20 THEN NULL", "lob": "WHEN 18 THEN 'MARINE'", "annual_premium": "WHEN 0 THEN 'abc' WHEN 1 THEN '0' WHEN 21 THEN NULL",
    "tenure_months": "WHEN 2 THEN '-1' WHEN 3 THEN '12.5' WHEN 22 THEN '99999999999'", "renewal_count": "WHEN 4 THEN 'x' WHEN 5 THEN '-2'",
    "claim_count_12m": "WHEN 6 THEN '-1' WHEN 19 THEN '1e0'", "claim_count_all": "WHEN 7 THEN '-3'",
    "claim_settled_pct": "WHEN 8 THEN '1.01' WHEN 9 THEN '-0.1' WHEN 23 THEN '0.5.1'", "days_to_settle_avg": "WHEN 10 THEN '-5'",
    "insured_age": "WHEN 11 THEN '17' WHEN 12 THEN '101' WHEN 15 THEN '18.0'", "channel": "WHEN 17 THEN 'Phone'",
    "policy_count_active": "WHEN 13 THEN '0'", "premium_change_pct": "WHEN 16 THEN 'NaN'", "last_contact_days": "WHEN 14 THEN 'soon'"}
WHOLE_BOUNDS = {
    "tenure_months": "0 AND 2147483647", "renewal_count": "0 AND 2147483647", "claim_count_12m": "0 AND 2147483647",
    "claim_count_all": "0 AND 2147483647", "insured_age": "18 AND 100", "policy_count_active": "1 AND 2147483647",
    "last_contact_days": "-2147483648 AND 2147483647"}
PASSES = {
    "policy_id": "policy_id IS NOT NULL", "lob": "lower(lob) IN ('auto', 'home', 'liability', 'health')",
    "annual_premium": "TRY_CAST(annual_premium AS DOUBLE) > 0", "claim_settled_pct": "TRY_CAST(claim_settled_pct AS DOUBLE) BETWEEN 0 AND 1",
    "days_to_settle_avg": "TRY_CAST(days_to_settle_avg AS DOUBLE) >= 0", "channel": "channel IN ('Direct', 'Broker', 'Online', 'Agent')",
    "premium_change_pct": "NOT isnan(TRY_CAST(premium_change_pct AS DOUBLE))",
    **{name: f"TRY_CAST({name} AS DOUBLE) = floor(TRY_CAST({name} AS DOUBLE)) AND TRY_CAST({name} AS DOUBLE) BETWEEN {ends}"
       for name, ends in WHOLE_BOUNDS.items()}}
TEXTED = POLICIES + """,
texted AS (SELECT client_no, """ + ", ".join(
    f"CASE client_no % 30 {cases} ELSE CAST({name} AS VARCHAR) END AS {name}" for name, cases in TEXTED_FIELDS.items()) + " FROM policies)"

NUMERIC = [
    "annual_premium", "tenure_months", "renewal_count", "claim_count_12m", "claim_count_all",
    "claim_settled_pct", "days_to_settle_avg", "insured_age", "policy_count_active",
    "premium_change_pct", "last_contact_days",
]
INTEGERS = {
    "tenure_months", "renewal_count", "claim_count_12m", "claim_count_all", "insured_age",
    "policy_count_active", "last_contact_days", "churn_label",
}
RECORD = [
    "policy_id", "lob", "annual_premium", "tenure_months", "renewal_count", "claim_count_12m",
    "claim_count_all", "claim_settled_pct", "days_to_settle_avg", "insured_age", "channel",
    "policy_count_active", "premium_change_pct", "last_contact_days", "churn_label",
]
DERIVED = [
    "premium_to_market_ratio", "is_overpriced", "log_premium", "premium_increased",
    "premium_increase_gt5pct", "has_recent_claim", "multi_claim", "claims_per_year",
    "has_unsettled_claim", "slow_settlement", "tenure_years", "log_tenure", "is_new_customer",
    "is_loyal_customer", "never_renewed", "log_renewals", "long_since_contact", "is_multi_line",
    "multi_line_discount_eligible", "age_segment_encoded", "is_young_adult", "is_online_customer",
    "is_broker_customer",
]
REAL_DERIVED = {"premium_to_market_ratio", "log_premium", "claims_per_year", "tenure_years", "log_tenure",
                "log_renewals"}


def _query(ctes, body):
    return f"WITH {ctes}\n{body}"


def _first_tree(ctes):
    """A tree of two levels over rows with probability one half: the best cut of every node among all cuts."""
    features = [
        "tenure_months", "claim_count_12m", "insured_age", "premium_change_pct", "last_contact_days", "policy_count_active"]
    values = " UNION ALL ".join(
        f"SELECT policy_id, {i} AS feature, CAST({name} AS DOUBLE) AS x FROM learnt" for i, name in enumerate(features))
    score = "(greatest(abs({g}) - 3, 0) * greatest(abs({g}) - 3, 0) / ({h} + 2))"
    weight = "(-sign({g}) * greatest(abs({g}) - 3, 0) / ({h} + 2) * CAST(0.3 AS DOUBLE))"

    def level(n, nodes):
        return f""",
sums{n} AS (
  SELECT node, feature, x, sum(g) AS g, sum(h) AS h FROM {nodes} JOIN long USING (policy_id) GROUP BY ALL),
whole{n} AS (SELECT node, sum(g) AS g_all, sum(h) AS h_all FROM {nodes} GROUP BY node),
cuts{n} AS (
  SELECT w.node, c.feature, c.x AS cut, g_all, h_all, coalesce(sum(s.g), 0) AS gl, coalesce(sum(s.h), 0) AS hl
  FROM whole{n} w CROSS JOIN cuts c LEFT JOIN sums{n} s ON s.node = w.node AND s.feature = c.feature AND s.x <= c.x GROUP BY ALL),
gains{n} AS (
  SELECT *, {score.format(g="gl", h="hl")} + {score.format(g="(g_all - gl)", h="(h_all - hl)")} - {score.format(g="g_all", h="h_all")} AS gain
  FROM cuts{n} WHERE hl >= 5 AND h_all - hl >= 5),
best{n} AS (
  SELECT * FROM gains{n} WHERE gain > CAST(0.000001 AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, cut) = 1),
at{n} AS (
  SELECT r.policy_id, r.g, r.h,
    CASE WHEN b.node IS NULL THEN r.node WHEN l.x <= b.cut THEN 2 * r.node ELSE 2 * r.node + 1 END AS node
  FROM {nodes} r LEFT JOIN best{n} b ON r.node = b.node LEFT JOIN long l ON l.policy_id = r.policy_id AND l.feature = b.feature)"""

    return _query(ctes + f""",
long AS ({values}),
cuts AS (SELECT DISTINCT feature, x FROM long l WHERE x < (SELECT max(x) FROM long m WHERE m.feature = l.feature)),
at0 AS (
  SELECT policy_id, 1 AS node, CASE WHEN churn_label = 1 THEN CAST(-1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS g,
    CASE WHEN churn_label = 1 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS h FROM learnt)""" + level(1, "at0") + level(2, "at1") + """,
leaves AS (SELECT node, sum(g) AS g, sum(h) AS h FROM at2 GROUP BY node)""", f"""
SELECT policy_id, round({weight.format(g="l.g", h="l.h")}, 9) AS margin FROM at2 JOIN leaves l USING (node)""")


def _r6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _select(names, real=()):
    """Column list with 6 decimals for the real ones."""
    return ", ".join(f"round({n}, 6) AS {n}" if n in real else n for n in names)


REAL = {n for n in NUMERIC if n not in INTEGERS} | REAL_DERIVED
MATRIX = NUMERIC + DERIVED


def _melt(source, columns, keep="", value="CAST({c} AS DOUBLE)"):
    keep_list = keep + ", " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {keep_list}CAST({i} AS INTEGER) AS column_index, '{c}' AS \"column\", {value.format(c=c)} AS v "
        f"FROM {source}" for i, c in enumerate(columns))


def _topk(n_rows_from, fraction, label="churn_label", order="churn_probability DESC, policy_id"):
    f = f"CAST({fraction} AS DOUBLE)"
    return f"""
ranked AS (SELECT {label} AS y, row_number() OVER (ORDER BY {order}) AS rn FROM {n_rows_from}),
sizes AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, CAST(floor(count(*) * {f}) AS BIGINT) AS k FROM ranked),
hits AS (SELECT coalesce(CAST(sum(y) AS BIGINT), 0) AS h FROM ranked, sizes WHERE rn <= k),
metrics AS (
  SELECT round_even((CASE WHEN k > 0 THEN h / CAST(k AS DOUBLE) ELSE 0 END) * 10000, 0) / 10000 AS "precision",
    round_even((CASE WHEN pos > 0 THEN h / CAST(pos AS DOUBLE) ELSE 0 END) * 10000, 0) / 10000 AS recall,
    round_even((CASE WHEN k > 0 AND pos > 0 THEN (h / CAST(k AS DOUBLE)) / (pos / CAST(n AS DOUBLE)) ELSE 0 END) * 100, 0) / 100 AS lift,
    {f} AS top_k, h AS churners_captured, pos AS total_churners
  FROM sizes, hits)"""


def _captures(source, fractions, order):
    values = ", ".join(f"(CAST({f} AS DOUBLE))" for f in fractions)
    return f"""
ranked AS (SELECT churn_label AS y, row_number() OVER (ORDER BY {order}) AS rn FROM {source}),
sizes AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM ranked),
cuts AS (SELECT f AS top_k, CAST(floor(n * f) AS BIGINT) AS k, n, pos FROM sizes, (VALUES {values}) t(f)),
captures AS (
  SELECT top_k, k, CAST(coalesce(sum(y), 0) AS BIGINT) AS captured, pos AS positives, n
  FROM cuts LEFT JOIN ranked ON rn <= k GROUP BY top_k, k, pos, n)"""


def _curve(source, by=""):
    part, keep = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""
distinct_scores AS (
  SELECT {keep}churn_probability AS p, count(*) AS n, sum(churn_label) AS pos FROM {source} GROUP BY ALL),
curve AS (
  SELECT *, sum(n) OVER ({part}ORDER BY p DESC) AS cum_n, sum(pos) OVER ({part}ORDER BY p DESC) AS cum_pos
  FROM distinct_scores),
curve_metrics AS (
  SELECT {keep}
    CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN
      sum(CAST(n - pos AS DOUBLE) * (cum_pos - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(n - pos) AS DOUBLE)) END AS auc,
    CASE WHEN sum(pos) > 0 THEN sum(pos * (CAST(cum_pos AS DOUBLE) / CAST(cum_n AS DOUBLE))) / CAST(sum(pos) AS DOUBLE) END AS avg_precision
  FROM curve {"GROUP BY " + by if by else ""})"""


def _ks(both, columns):
    """`both` is a relation with a 0/1 column is_ref."""
    return f"""
cells AS (SELECT * FROM ({_melt(both, columns, "is_ref")}) WHERE v IS NOT NULL),
vals AS (
  SELECT column_index, "column", v, sum(is_ref) AS a, sum(1 - is_ref) AS b FROM cells GROUP BY ALL),
sizes AS (SELECT column_index, CAST(sum(a) AS BIGINT) AS na, CAST(sum(b) AS BIGINT) AS nb FROM vals GROUP BY ALL),
steps AS (
  SELECT column_index, "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM vals
  WINDOW w AS (PARTITION BY column_index ORDER BY v)),
gaps AS (
  SELECT column_index, "column", na AS size_ref, nb AS size_cur,
    max(abs(ca / CAST(na AS DOUBLE) - cb / CAST(nb AS DOUBLE))) AS statistic
  FROM steps JOIN sizes USING (column_index) GROUP BY ALL),
scaled AS (
  SELECT *, sqrt(CAST(size_ref AS DOUBLE) * size_cur / (size_ref + size_cur)) * statistic AS z FROM gaps),
series AS (
  SELECT column_index, sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(CAST(-2 AS DOUBLE) * i * i * z * z)) AS s
  FROM scaled, range(1, 101) r(i) GROUP BY column_index),
ks AS (
  SELECT column_index, "column", size_ref, size_cur, statistic,
    CASE WHEN z < CAST(0.2 AS DOUBLE) THEN CAST(1 AS DOUBLE)
      ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 2 * s)) END AS p_value
  FROM scaled JOIN series USING (column_index)),
ks_tests AS (SELECT *, p_value < CAST(0.05 AS DOUBLE) AS drifted FROM ks)"""


CHI2_CRITICAL = "CASE dof WHEN 1 THEN CAST(3.841458820694124 AS DOUBLE) WHEN 3 THEN CAST(7.814727903251179 AS DOUBLE) END"


def _chi2(both):
    return f"""
cats AS (
  SELECT column_index, "column", v, CAST(sum(is_ref) AS DOUBLE) AS a, CAST(sum(1 - is_ref) AS DOUBLE) AS b
  FROM ({_melt(both, ["lob", "channel", "churn_label"], "is_ref", "CAST({c} AS VARCHAR)")}) GROUP BY ALL),
expected AS (
  SELECT *, (a + b) * sum(a) OVER w / sum(a + b) OVER w AS ea, (a + b) * sum(b) OVER w / sum(a + b) OVER w AS eb
  FROM cats WINDOW w AS (PARTITION BY column_index)),
chi2 AS (
  SELECT column_index, "column", sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS statistic,
    CAST(count(*) - 1 AS INTEGER) AS dof
  FROM expected GROUP BY ALL),
halves AS (SELECT *, statistic / 2 AS h, CAST(dof % 2 AS DOUBLE) / 2 AS s0 FROM chi2),
chi2_terms AS (
  -- Q(dof/2, h): erfc(sqrt(h)) for an odd number of degrees, by the series of erf, and one term per two degrees.
  SELECT column_index,
    (SELECT 1 - 2 / sqrt(pi()) * sum((CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(sqrt(h)) - lgamma(n + 1)) / (2 * n + 1))
     FROM range(0, 120) r(n)) AS erfc,
    (SELECT coalesce(sum(exp((s0 + k) * ln(h) - h - lgamma(s0 + k + 1))), 0) FROM range(0, dof // 2) r(k)) AS terms
  FROM halves),
chi2_tests AS (
  SELECT chi2.*, CASE WHEN statistic <= 0 THEN CAST(1 AS DOUBLE) ELSE CASE WHEN dof % 2 = 1 THEN erfc ELSE 0 END + terms END AS p_value,
    statistic > {CHI2_CRITICAL} AS drifted
  FROM chi2 JOIN chi2_terms USING (column_index))"""


def _histogram(source, columns):
    return f"""
cells AS (SELECT * FROM ({_melt(source, columns, "churn_label")}) WHERE v IS NOT NULL),
ranges AS (
  SELECT churn_label, "column", CASE WHEN min(v) = max(v) THEN min(v) - CAST(0.5 AS DOUBLE) ELSE min(v) END AS lo,
    CASE WHEN min(v) = max(v) THEN max(v) + CAST(0.5 AS DOUBLE) ELSE max(v) END AS hi
  FROM cells GROUP BY ALL),
placed AS (
  SELECT *, (hi - lo) / CAST(30 AS DOUBLE) AS w, CAST(least(29, floor((v - lo) / ((hi - lo) / CAST(30 AS DOUBLE)))) AS INTEGER) AS g
  FROM cells JOIN ranges USING (churn_label, "column")),
binned AS (
  SELECT *, CASE WHEN g > 0 AND v < lo + g * w THEN g - 1 WHEN g < 29 AND v >= lo + (g + 1) * w THEN g + 1 ELSE g END AS bin
  FROM placed)
SELECT column_index, "column", churn_label, CAST(bin AS INTEGER) AS bin, count(*) AS n,
  round(min(lo), 6) AS range_low, round(max(hi), 6) AS range_high
FROM binned GROUP BY column_index, "column", churn_label, bin"""


TIER_RIGHT = """CASE WHEN {p} >= 0 AND {p} <= CAST(0.2 AS DOUBLE) THEN 'low'
  WHEN {p} > CAST(0.2 AS DOUBLE) AND {p} <= CAST(0.45 AS DOUBLE) THEN 'medium'
  WHEN {p} > CAST(0.45 AS DOUBLE) AND {p} <= CAST(0.7 AS DOUBLE) THEN 'high'
  WHEN {p} > CAST(0.7 AS DOUBLE) AND {p} <= 1 THEN 'critical' END"""
TIER_LEFT = """CASE WHEN {p} >= 0 AND {p} < CAST(0.2 AS DOUBLE) THEN 'low'
  WHEN {p} >= CAST(0.2 AS DOUBLE) AND {p} < CAST(0.45 AS DOUBLE) THEN 'medium'
  WHEN {p} >= CAST(0.45 AS DOUBLE) AND {p} < CAST(0.7 AS DOUBLE) THEN 'high' ELSE 'critical' END"""
RIGHT, LEFT = TIER_RIGHT.format(p="churn_probability"), TIER_LEFT.format(p="churn_probability")
ACTION = """CASE risk_tier WHEN 'low' THEN 'no_action' WHEN 'medium' THEN 'soft_retention'
  WHEN 'high' THEN 'proactive_outreach' ELSE 'urgent_retention' END"""
CLV = """round_even((annual_premium * (1 - pow(CAST(1.08 AS DOUBLE),
  -greatest(CAST(1 AS DOUBLE), (60 - tenure_months) / CAST(12 AS DOUBLE)))) / CAST(0.08 AS DOUBLE)) * 100, 0) / 100"""
SPLIT_REF = "SELECT *, (client_no % 10 < 7)::INT AS is_ref FROM policies"
TENURE_REF = "SELECT *, (tenure_months > 35)::INT AS is_ref FROM policies"
BY_ID = "churn_probability DESC, policy_id"

LIFT = """
SELECT top_k, k, captured, round(captured / CAST(positives AS DOUBLE), 6) AS share_captured,
  round(captured / CAST(positives AS DOUBLE) / (k / CAST(n AS DOUBLE)), 6) AS lift FROM captures"""
BY_LINE = "churn_probability DESC, l_orderkey, l_linenumber, churn_label DESC"

CONTRIBUTIONS = """
weights(feature, w) AS (VALUES ('claim_count_12m', CAST(0.6 AS DOUBLE)), ('tenure_months', CAST(-0.07 AS DOUBLE)),
  ('premium_change_pct', CAST(0.03 AS DOUBLE))),
feature_cells AS (SELECT policy_id, "column" AS feature, v AS value FROM ({melted})),
feature_means AS (SELECT feature, avg(value) AS m FROM feature_cells GROUP BY feature),
contributions AS (
  SELECT policy_id, feature, value, w * (value - m) AS contribution
  FROM feature_cells JOIN feature_means USING (feature) JOIN weights USING (feature))"""
CARD = ["claim_count_12m", "tenure_months", "premium_change_pct"]


def _contributions(source):
    return CONTRIBUTIONS.format(melted=_melt(source, CARD, "policy_id"))


def statements():
    out = {}
    record = ", ".join(RECORD)
    out["overpriced_by_lob"] = _query(FEATURES, """
SELECT lob, count(*) AS n_policies, round(avg(is_overpriced), 6) AS overpriced_share,
  round(avg(premium_to_market_ratio), 6) AS mean_ratio, round(avg(churn_label), 6) AS label_rate
FROM features GROUP BY lob""")

    # Sources and sinks.
    modelled = {"PPERSAUT", "PBRAND", "PWAPART", "PLEVEN", "PMOTSCO", "AWAPART", "APERSAUT", "MAANTHUI",
                "MGEMLEEF", "MKOOPKLA", "CARAVAN"}
    out["src_contract_tsv"] = _query(RAW, "SELECT " + ", ".join(
        c if c in modelled else f"CAST(0 AS INTEGER) AS {c}" for c in RAW_COLUMNS) + " FROM raw")
    out["attach_by_position"] = _query(RAW, """
SELECT row_number() OVER (ORDER BY client_no) - 1 AS row_no, PPERSAUT, PBRAND, MAANTHUI, MGEMLEEF, MKOOPKLA, CARAVAN
FROM raw""")
    out["ingest_files"] = _query(RAW, """
SELECT CASE WHEN client_no % 5 = 4 THEN 'test' ELSE 'train' END AS dataset, count(*) AS n_rows,
  CAST(15 AS INTEGER) AS n_columns, round(avg(CARAVAN), 6) AS positive_rate
FROM raw GROUP BY 1""")
    out["scan_policies"] = _query(POLICIES, f"SELECT {record} FROM policies")
    out["sink_policies"] = _query(POLICIES, """
SELECT CASE WHEN row_number() OVER (ORDER BY length(policy_id), policy_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
  THEN 'train' ELSE 'test' END AS dataset, policy_id, annual_premium, churn_label FROM policies""")
    matrix = _query(FEATURES, f"SELECT policy_id, churn_label, {_select(MATRIX, REAL)} FROM features")
    out["sink_features"] = matrix
    out["state_fallback"] = _query(POLICIES, """
SELECT policy_id, CAST(1 AS DOUBLE) AS premium_to_market_ratio, CAST(0 AS INTEGER) AS is_overpriced FROM policies""")
    out["load_summary"] = _query(POLICIES, """
SELECT 'policies' AS dataset, count(*) AS n_rows, CAST(15 AS INTEGER) AS n_columns,
  round(avg(churn_label), 6) AS positive_rate FROM policies""")

    # Translation.
    for key, columns in {
        "tr_policy_id": ["policy_id"],
        "tr_lob_argmax": ["policy_id", "lob"],
        "tr_premium": ["policy_id", "annual_premium"],
        "tr_tenure": ["policy_id", "tenure_months", "renewal_count"],
        "tr_claims": ["policy_id", "claim_count_12m", "claim_count_all", "claim_settled_pct", "days_to_settle_avg"],
        "tr_age": ["policy_id", "insured_age"],
        "tr_channel": ["policy_id", "channel"],
        "tr_policy_count": ["policy_id", "policy_count_active"],
        "translate": RECORD,
    }.items():
        out[key] = _query(POLICIES, f"SELECT {', '.join(columns)} FROM policies")

    # Validation.
    out["validate_rules"] = _query(DIRTY, """
SELECT d.client_no, coalesce(string_agg(rule, ',' ORDER BY pos), '') AS reasons
FROM dirty d LEFT JOIN faults f ON d.client_no = f.client_no GROUP BY d.client_no""")
    out["normalize_lob"] = _query(DIRTY, "SELECT client_no, lower(lob) AS lob FROM dirty")
    out["apply_defaults"] = _query(SPARSE, """
SELECT policy_id, CAST(0 AS INTEGER) AS renewal_count, CAST(30 AS DOUBLE) AS days_to_settle_avg,
  coalesce(claim_settled_pct, CAST(1 AS DOUBLE)) AS claim_settled_pct,
  coalesce(policy_count_active, 1) AS policy_count_active, last_contact_days
FROM sparse""")
    out["fill_last_contact"] = _query(SPARSE, """
SELECT policy_id, coalesce(last_contact_days, 90) AS last_contact_days FROM sparse""")
    out["validate_split"] = _query(DIRTY, """
SELECT CASE WHEN client_no IN (SELECT client_no FROM faults) THEN 'rejected' ELSE 'valid' END AS status,
  client_no, policy_id, lower(lob) AS lob,
  CASE WHEN NOT isnan(annual_premium) THEN annual_premium END AS annual_premium, insured_age, last_contact_days
FROM dirty""")
    whole = "CAST(CASE WHEN {0} THEN TRY_CAST({1} AS DOUBLE) END AS INTEGER) AS {1}"
    parsed = ["tenure_months", "claim_count_12m", "insured_age"]
    fits = "TRY_CAST({0} AS DOUBLE) = floor(TRY_CAST({0} AS DOUBLE)) AND abs(TRY_CAST({0} AS DOUBLE)) <= 2147483647"
    out["validate_types"] = _query(TEXTED, "SELECT client_no, concat_ws(',', " + ", ".join(
        f"CASE WHEN coalesce({PASSES[name]}, false) THEN NULL ELSE '{name}' END" for name in TEXTED_FIELDS) + ") AS reasons, "
        + ", ".join(whole.format(fits.format(name), name) for name in parsed) + """,
  CASE WHEN NOT isnan(TRY_CAST(premium_change_pct AS DOUBLE)) THEN TRY_CAST(premium_change_pct AS DOUBLE) END AS premium_change_pct
FROM texted""")
    out["validate_reject"] = _query(SPARSE, """
SELECT client_no, concat_ws(',', CASE WHEN claim_settled_pct IS NULL THEN 'claim_settled_pct' END,
    CASE WHEN policy_count_active IS NULL THEN 'policy_count_active' END) AS reasons,
  CAST(0 AS INTEGER) AS renewal_count, policy_count_active
FROM sparse""")
    out["reject_counts"] = _query(DIRTY, "SELECT rule, count(*) AS n_rejected FROM faults GROUP BY rule")

    unit = "((CAST(CAST('0x' || substr(md5(client_no || '/42/' || '{0}'), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"
    out["tr_premium_change"] = _query(RAW + f""",
noisy AS (
  SELECT client_no, greatest(1, MAANTHUI) * 6 + CAST(floor({unit.format("tenure")} * 6) AS INTEGER) AS t,
    CAST(floor({unit.format("contact")} * 50) AS INTEGER) + 10 AS contact,
    2 + 5 * sqrt(-2 * ln({unit.format("change-radius")})) * cos(2 * pi() * {unit.format("change-angle")}) AS change
  FROM raw)""", """
SELECT printf('POL%07d', client_no) AS policy_id, CAST(t AS INTEGER) AS tenure_months,
  round_even(change, 1) AS premium_change_pct, CAST(t % 90 + contact AS INTEGER) AS last_contact_days
FROM noisy""")

    # Fit and features.
    out["fit_market"] = out["market_medians"] = _query(STATE, "SELECT lob, market_median FROM state")
    groups = {
        "feat_premium": DERIVED[0:5], "feat_claims": DERIVED[5:10], "feat_loyalty": DERIVED[10:17],
        "feat_portfolio": DERIVED[17:19], "feat_lifecycle": DERIVED[19:23],
    }
    for key, columns in groups.items():
        out[key] = _query(FEATURES, f"SELECT policy_id, {_select(columns, REAL)} FROM features")
    out["feature_matrix"] = _query(FEATURES, f"SELECT policy_id, {_select(MATRIX, REAL)} FROM features")
    out["training_features"] = matrix
    out["inference_features"] = _query(POLICIES + """,
state AS (SELECT lob, median(annual_premium) AS market_median FROM policies WHERE client_no % 10 < 7 GROUP BY lob),
features AS (""" + FEATURES_OF + ")", f"SELECT policy_id, {_select(MATRIX, REAL)} FROM features WHERE client_no % 10 >= 7")

    described = {c: FEATURE_DESCRIPTIONS.get(c, "").replace("'", "''") for c in DERIVED}
    out["feature_catalog"] = _query(FEATURES, " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, '{described[c]}' AS description, "
        f"count({c}) AS n_present, round(avg({c}), 6) AS mean FROM features" for i, c in enumerate(DERIVED)))

    # Order and splits.
    out["global_rank"] = _query(SCORES, f"SELECT policy_id, row_number() OVER (ORDER BY {BY_ID}) AS rn FROM scores")
    out["rank_lines"] = _query(FINE_LINES, """
SELECT l_orderkey, l_linenumber, churn_probability, count(*) AS n,
  CAST(sum(count(*)) OVER (ORDER BY churn_probability DESC, l_orderkey, l_linenumber) AS BIGINT) AS last_rank
FROM lines GROUP BY l_orderkey, l_linenumber, churn_probability""")
    out["split_ordered"] = _query(POLICIES, """
SELECT policy_id, CASE WHEN row_number() OVER (ORDER BY length(policy_id), policy_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
  THEN 'train' ELSE 'test' END AS part FROM policies""")
    out["split_by_tenure"] = _query(POLICIES, """
SELECT policy_id, CASE WHEN row_number() OVER (ORDER BY tenure_months DESC, policy_id)
  <= floor(count(*) OVER () * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM policies""")
    out["split_wide_ids"] = _query(POLICIES, """
SELECT 'POL' || CAST(client_no + 9999900 AS VARCHAR) AS policy_id, CASE WHEN row_number() OVER (ORDER BY client_no)
  <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM policies""")
    out["split_missing"] = _query(POLICIES, """
SELECT policy_id, CASE WHEN row_number() OVER (
    ORDER BY CASE WHEN client_no % 5 > 1 THEN tenure_months END NULLS LAST, policy_id)
  <= floor(count(*) OVER () * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM policies""")
    out["time_folds"] = _query(POLICIES + """,
ordered AS (SELECT policy_id, row_number() OVER (ORDER BY length(policy_id), policy_id) AS rn, count(*) OVER () AS n FROM policies),
folds AS (SELECT CAST(i AS INTEGER) AS fold FROM range(1, 6) t(i))""", """
SELECT policy_id, fold, CASE WHEN rn <= n - (6 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM ordered, folds WHERE rn <= n - (5 - fold) * (n // 6)""")

    # Profiles.
    sparse_columns = ["policy_id", "lob", "annual_premium", "tenure_months", "claim_count_12m", "claim_count_all",
                      "claim_settled_pct", "insured_age", "channel", "policy_count_active", "premium_change_pct",
                      "last_contact_days", "client_no"]
    sparse_types = ["string", "string", "double", "int", "int", "int", "double", "int", "string", "int", "double", "int", "bigint"]
    out["profile_nulls"] = _query(SPARSE, " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS column_index, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, "
        f"count({c}) AS n_non_null FROM sparse" for i, (c, t) in enumerate(zip(sparse_columns, sparse_types))))
    out["head_rows"] = _query(POLICIES, f"SELECT {record} FROM policies ORDER BY policy_id LIMIT 5")
    out["profile_describe"] = _query(POLICIES, f"""
SELECT column_index, "column", count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS "max"
FROM ({_melt("policies", NUMERIC + ["churn_label"])}) GROUP BY column_index, "column" """)
    out["target_distribution"] = _query(POLICIES, """
SELECT churn_label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM policies GROUP BY churn_label""")
    out["hist_by_class"] = _query(POLICIES + "," + _histogram("policies", NUMERIC), "").strip()
    out["hist_derived"] = _query(FEATURES + "," + _histogram("features", DERIVED), "").strip()
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[:i]]
    out["corr_matrix"] = _query(POLICIES, " UNION ALL ".join(
        f"SELECT '{a}' AS row_feature, '{b}' AS column_feature, round(corr({a}, {b}), 6) AS correlation FROM policies"
        for a, b in pairs))
    out["corr_with_label"] = _query(FEATURES, " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN min({c}) < max({c}) THEN round(corr({c}, churn_label), 6) END "
        f"AS correlation FROM features" for c in DERIVED))
    for c in ("lob", "channel"):
        out[f"rate_by_{c}"] = _query(POLICIES, f"""
SELECT {c}, round(avg(churn_label), 6) AS rate, count(*) AS n FROM policies GROUP BY {c}""")
    out["premium_tenure_grid"] = _query(POLICIES, """
SELECT churn_label, CAST(tenure_months // 12 * 12 AS INTEGER) AS tenure_from,
  floor(annual_premium / CAST(100 AS DOUBLE)) * 100 AS premium_from, count(*) AS n
FROM policies GROUP BY 1, 2, 3""")

    # Scoring.
    out["tier_batch"] = _query(SCORES, f"SELECT policy_id, churn_probability, {RIGHT} AS risk_tier FROM scores")
    out["tier_online"] = _query(SCORES, f"SELECT policy_id, churn_probability, {LEFT} AS risk_tier FROM scores")
    out["tier_edges"] = _query(LINES + """,
wide AS (SELECT round(churn_probability * 2 - CAST(0.05 AS DOUBLE), 2) AS churn_probability FROM lines)""", f"""
SELECT churn_probability, {RIGHT} AS batch_tier, {LEFT} AS online_tier, count(*) AS n FROM wide GROUP BY ALL""")
    tiered = SCORES + f",\ntiered AS (SELECT *, {LEFT} AS risk_tier FROM scores)"
    out["retention_action"] = _query(tiered, f"SELECT policy_id, risk_tier, {ACTION} AS recommended_action FROM tiered")
    out["clv"] = _query(POLICIES, f"SELECT policy_id, {CLV} AS estimated_clv FROM policies")
    out["prediction_rows"] = _query(tiered, f"""
SELECT policy_id, round_even((churn_probability) * 10000, 0) / 10000 AS churn_probability, risk_tier,
  {ACTION} AS recommended_action, {CLV} AS estimated_clv, 'retention_scorecard@Production' AS model_version
FROM tiered""")
    out["batch_result"] = _query(SCORES + f",\ntiered AS (SELECT *, {RIGHT} AS risk_tier FROM scores)", """
SELECT policy_id, churn_probability, risk_tier, CAST(CASE risk_tier WHEN 'low' THEN 0 WHEN 'medium' THEN 1
  WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END AS INTEGER) AS tier_rank FROM tiered""")
    out["at_risk_summary"] = _query(SCORES + """,
asked AS (
  SELECT policy_id, annual_premium, churn_probability, client_no AS pos FROM scores
  UNION ALL SELECT policy_id, annual_premium * 2, churn_probability, client_no + 1000000000 FROM scores
  WHERE client_no % 50 = 0),
firsts AS (SELECT policy_id, arg_min(annual_premium, pos) AS premium FROM asked GROUP BY policy_id)""", """
SELECT count(*) AS total_at_risk, round_even((coalesce(sum(premium), 0)) * 100, 0) / 100 AS total_premium_at_risk
FROM asked JOIN firsts USING (policy_id) WHERE churn_probability >= CAST(0.45 AS DOUBLE)""")
    out["stream_summary_total"] = out["at_risk_summary"]
    out["stream_score"] = _query(DIRTY + """,
good AS (
  SELECT policy_id, round(CAST(1 AS DOUBLE) / (1 + exp(-(CAST(-2.5 AS DOUBLE)
    + CAST(0.6 AS DOUBLE) * claim_count_12m - CAST(0.07 AS DOUBLE) * (tenure_months - 36)
    + CAST(0.03 AS DOUBLE) * premium_change_pct))), 6) AS churn_probability
  FROM dirty WHERE client_no NOT IN (SELECT client_no FROM faults))""",
        f"SELECT policy_id, churn_probability, {RIGHT} AS risk_tier FROM good")
    out["stream_rejects"] = _query(DIRTY, """
SELECT reasons, count(*) AS n FROM (
  SELECT string_agg(rule, ',' ORDER BY pos) AS reasons FROM faults GROUP BY client_no) GROUP BY reasons""")
    out["stream_summary"] = _query(SCORES, """
SELECT count(*) AS total_at_risk, round(coalesce(sum(annual_premium), 0), 2) AS total_premium_at_risk
FROM scores WHERE churn_probability >= CAST(0.45 AS DOUBLE)""")

    # Evaluation.
    for key, fraction in (("topk_10", "0.10"), ("topk_15", "0.15")):
        out[key] = _query(SCORES + "," + _topk("scores", fraction), "SELECT * FROM metrics")
    gaps = SCORES.replace("scores AS (", "all_scores AS (") + """,
scores AS (SELECT policy_id, churn_label, CASE WHEN client_no % 5 > 1 THEN churn_probability END AS churn_probability FROM all_scores)"""
    by_gaps = "churn_probability DESC NULLS LAST, policy_id"
    out["topk_missing"] = _query(gaps + "," + _captures("scores", ["0.1", "0.5", "0.7", "0.9"], by_gaps), "SELECT * FROM captures")
    out["lift_missing"] = _query(gaps + "," + _captures("scores", ["0.1", "0.15", "0.2", "0.5", "1.0"], by_gaps), LIFT)
    fractions = ["0.1", "0.15", "0.29", "0.5"]
    out["topk_lines"] = _query(LINES + "," + _captures("lines", fractions, BY_LINE), "SELECT * FROM captures")
    out["topk_lines_fine"] = _query(FINE_LINES + "," + _captures("lines", fractions, BY_LINE), "SELECT * FROM captures")
    out["gains_curve"] = _query(SCORES, f"""
SELECT policy_id, row_number() OVER w AS rn,
  round(row_number() OVER w / CAST(count(*) OVER () AS DOUBLE), 6) AS share_contacted,
  round(sum(churn_label) OVER w / CAST(sum(churn_label) OVER () AS DOUBLE), 6) AS share_captured
FROM scores WINDOW w AS (ORDER BY {BY_ID})""")
    out["lift_table"] = _query(SCORES + "," + _captures("scores", ["0.1", "0.15", "0.2", "0.5", "1.0"], BY_ID), LIFT)
    out["roc_points"] = _query(SCORES + "," + _curve("scores"), """
SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL SELECT p, round((cum_n - cum_pos) / CAST(sum(n - pos) OVER () AS DOUBLE), 6),
  round(cum_pos / CAST(sum(pos) OVER () AS DOUBLE), 6) FROM curve""")
    for key, ctes, source in (("", SCORES, "scores"), ("_lines", LINES, "lines"), ("_lines_fine", FINE_LINES, "lines")):
        for metric in ("auc", "avg_precision"):
            if metric + key != "avg_precision_lines":
                out[metric + key] = _query(ctes + "," + _curve(source), f"SELECT round({metric}, 6) AS {metric} FROM curve_metrics")
    out["brier"] = _query(SCORES, """
SELECT round(avg((churn_probability - churn_label) * (churn_probability - churn_label)), 6) AS brier FROM scores""")
    edges = " + ".join(f"(churn_probability > {i} * CAST(0.1 AS DOUBLE))::INT" for i in range(1, 10))
    out["calibration"] = _query(SCORES, f"""
SELECT CAST({edges} AS INTEGER) AS bin, count(*) AS n, round(avg(churn_probability), 6) AS mean_predicted,
  round(avg(churn_label), 6) AS fraction_positive FROM scores GROUP BY 1""")
    report = SCORES + "," + _curve("scores") + ",\n" + ",\n".join(
        f"{name} AS (WITH {_topk('scores', fraction)} SELECT * FROM metrics)"
        for name, fraction in (("top10", "0.10"), ("top15", "0.15"))) + """,
overall AS (
  SELECT round_even((auc) * 10000, 0) / 10000 AS auc_roc, round_even((avg_precision) * 10000, 0) / 10000 AS avg_precision,
    (SELECT round_even((avg((churn_probability - churn_label) * (churn_probability - churn_label))) * 10000, 0) / 10000 FROM scores) AS brier_score
  FROM curve_metrics)"""
    pieces = [f"SELECT 'overall' AS section, '{m}' AS metric, {m} AS value FROM overall"
              for m in ("auc_roc", "avg_precision", "brier_score")]
    pieces += [
        f"SELECT 'business_metrics_{pct}pct', '{m}', CAST(\"{m}\" AS DOUBLE) FROM top{pct}"
        for pct in (10, 15)
        for m in ("precision", "recall", "lift", "top_k", "churners_captured", "total_churners")]
    out["eval_report"] = _query(report, " UNION ALL ".join(pieces))
    out["quality_gate"] = _query(SCORES + "," + _curve("scores"), """
SELECT round_even((auc) * 10000, 0) / 10000 AS auc_roc, CAST(0.7 AS DOUBLE) AS min_auc,
  round_even((auc) * 10000, 0) / 10000 >= CAST(0.7 AS DOUBLE) AS passed FROM curve_metrics""")
    out["model_comparison"] = _query(SCORES + f""",
both_models AS (
  SELECT 'scorecard' AS model, churn_probability, churn_label FROM scores
  UNION ALL SELECT 'tenure_card', {TENURE_CARD}, churn_label FROM policies),""" + _curve("both_models", "model") + """,
briers AS (
  SELECT model, avg((churn_probability - churn_label) * (churn_probability - churn_label)) AS brier
  FROM both_models GROUP BY model)""", f"SELECT model, {_r6('auc', 'avg_precision', 'brier')} FROM curve_metrics JOIN briers USING (model)")

    # Monitoring.
    ks_select = f'SELECT column_index, "column", size_ref, size_cur, {_r6("statistic", "p_value")}, drifted FROM ks_tests'
    out["ks_columns"] = _query(POLICIES + f",\nsides AS ({SPLIT_REF})," + _ks("sides", NUMERIC), ks_select)
    types = ["click", "error", "purchase", "signup", "view"]
    wide = ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in types)
    out["ks_events"] = _query(f"""
sides AS (SELECT (ts < TIMESTAMP '2024-01-16')::INT AS is_ref, {wide} FROM events),""" + _ks("sides", types), ks_select)
    tenure_tests = POLICIES + f",\nsides AS ({TENURE_REF})," + _ks("sides", NUMERIC)
    out["drift_summary"] = _query(tenure_tests + """,
drifts AS (
  SELECT string_agg("column", ',' ORDER BY column_index) FILTER (WHERE drifted) AS names,
    count(*) FILTER (WHERE drifted) / CAST(11 AS DOUBLE) AS share FROM ks_tests)""", """
SELECT 'ks_test_fallback' AS method, round(share, 6) AS share_drifted_features, coalesce(names, '') AS drifted_columns,
  share > CAST(0.15 AS DOUBLE) AS alert, share > CAST(0.15 AS DOUBLE) AS dataset_drift_detected FROM drifts""")
    out["chi2_columns"] = _query(POLICIES + f",\nsides AS ({SPLIT_REF})," + _chi2("sides"), """
SELECT column_index, "column", round(statistic, 6) AS statistic, dof, round(p_value, 6) AS p_value, drifted FROM chi2_tests""")
    out["drift_report"] = _query(tenure_tests + "," + _chi2("sides") + """,
tests AS (SELECT drifted FROM ks_tests UNION ALL SELECT drifted FROM chi2_tests),
shares AS (SELECT count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) AS share FROM tests)""", """
SELECT round(share, 6) AS share_drifted_features, share >= CAST(0.5 AS DOUBLE) AS dataset_drift_detected,
  share > CAST(0.15 AS DOUBLE) AS alert,
  (SELECT CAST(sum(is_ref) AS BIGINT) FROM sides) AS n_reference,
  (SELECT CAST(sum(1 - is_ref) AS BIGINT) FROM sides) AS n_current FROM shares""")
    out["drift_job"] = _query(
        SCORES + f",\nsides AS ({TENURE_REF})," + _ks("sides", NUMERIC) + "," + _chi2("sides") + """,
tests AS (SELECT drifted FROM ks_tests UNION ALL SELECT drifted FROM chi2_tests),
shares AS (SELECT count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) AS share FROM tests),
sided AS (
  SELECT CASE WHEN tenure_months > 35 THEN 'ref' ELSE 'cur' END AS side, churn_probability, churn_label FROM scores),""" + _curve("sided", "side") + """,
aucs AS (SELECT max(CASE WHEN side = 'ref' THEN auc END) AS a, max(CASE WHEN side = 'cur' THEN auc END) AS b FROM curve_metrics)""", """
SELECT round(share, 6) AS share_drifted_features, share >= CAST(0.5 AS DOUBLE) AS dataset_drift_detected,
  share > CAST(0.15 AS DOUBLE) AS data_alert,
  (SELECT CAST(sum(is_ref) AS BIGINT) FROM sides) AS n_reference,
  (SELECT CAST(sum(1 - is_ref) AS BIGINT) FROM sides) AS n_current,
  round(a, 6) AS baseline_auc, round(b, 6) AS current_auc, a - b > CAST(0.05 AS DOUBLE) AS alert,
  CASE WHEN a - b > CAST(0.05 AS DOUBLE) THEN 'retrain' ELSE 'ok' END AS recommendation FROM shares, aucs""")
    out["auc_drift"] = _query(SCORES + """,
sided AS (
  SELECT lob || CASE WHEN client_no % 10 < 7 THEN '/ref' ELSE '/cur' END AS side, churn_probability, churn_label
  FROM scores),""" + _curve("sided", "side") + """,
by_side AS (SELECT split_part(side, '/', 1) AS lob, split_part(side, '/', 2) AS which, round(auc, 6) AS auc FROM curve_metrics),
paired AS (
  SELECT r.lob, r.auc AS baseline_auc, c.auc AS current_auc, r.auc - c.auc AS auc_drop
  FROM by_side r JOIN by_side c ON r.lob = c.lob AND r.which = 'ref' AND c.which = 'cur')""", """
SELECT lob, baseline_auc, current_auc, round(auc_drop, 6) AS auc_drop, auc_drop > CAST(0.05 AS DOUBLE) AS alert,
  CASE WHEN auc_drop > CAST(0.05 AS DOUBLE) THEN 'retrain' ELSE 'ok' END AS recommendation FROM paired""")
    out["model_card_facts"] = _query(SCORES + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY length(policy_id), policy_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS is_train FROM scores),
held_out AS (SELECT * FROM ordered WHERE NOT is_train),""" + _curve("held_out") + "," + _topk("held_out", "0.10")
        + "," + _contributions("held_out") + """,
lead_features AS (SELECT feature, avg(abs(contribution)) AS value FROM contributions GROUP BY feature)""", """
SELECT 'data' AS section, CAST(0 AS INTEGER) AS position, 'n_train' AS name, CAST(count(*) AS DOUBLE) AS value FROM ordered WHERE is_train
UNION ALL SELECT 'data', 1, 'n_test', CAST(count(*) AS DOUBLE) FROM held_out
UNION ALL SELECT 'data', 2, 'positive_rate', round(avg(churn_label), 6) FROM ordered
UNION ALL SELECT 'performance', 0, 'auc_roc', round(auc, 6) FROM curve_metrics
UNION ALL SELECT 'performance', 1, 'precision_at_10', "precision" FROM metrics
UNION ALL SELECT 'performance', 2, 'recall', recall FROM metrics
UNION ALL SELECT 'features', CAST(row_number() OVER (ORDER BY value DESC, feature) - 1 AS INTEGER), feature, round(value, 6) FROM lead_features""")

    cards = {"scorecard": "churn_probability", "tenure_card": TENURE_CARD}
    out["run_log"] = _query(SCORES + """,
both_models AS (""" + " UNION ALL ".join(
        f"SELECT '{name}' AS model, {p} AS churn_probability, churn_label FROM scores"
        for name, p in cards.items()) + ")," + _curve("both_models", "model"), """
SELECT model AS run_name, 'param' AS kind, 'model_type' AS name, model AS value FROM curve_metrics
UNION ALL SELECT model, 'metric', 'auc_roc', CAST(round(auc, 6) AS VARCHAR) FROM curve_metrics
UNION ALL SELECT model, 'metric', 'avg_precision', CAST(round(avg_precision, 6) AS VARCHAR) FROM curve_metrics""")
    out["batch_score"] = _query(POLICIES, "SELECT policy_id, true AS is_probability, true AS tier_fits FROM policies")
    out["train_baseline"] = _query(POLICIES, """
SELECT CAST(0 AS DOUBLE) AS gradient, CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS n_train,
  count(*) - CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS n_test, true AS are_probabilities FROM policies""")
    ordered = POLICIES + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY length(policy_id), policy_id) AS rn, count(*) OVER () AS n FROM policies),
learnt AS (SELECT * FROM ordered WHERE rn <= floor(n * CAST(0.8 AS DOUBLE))),
tested AS (SELECT * FROM ordered WHERE rn > floor(n * CAST(0.8 AS DOUBLE)))"""
    out["calibrate_platt"] = _query(ordered + """,
classes AS (SELECT CAST(sum(churn_label) AS DOUBLE) AS p, CAST(sum(1 - churn_label) AS DOUBLE) AS q FROM learnt),
targets AS (SELECT round((p * (p + 1) / (p + 2) + q / (q + 2)) / (p + q), 5) AS mean_target FROM classes)""", """
SELECT mean_target AS mean_calibrated, mean_target, CAST(0 AS DOUBLE) AS slope_gap FROM targets""")
    for name in ("train_gbt", "train_gbt_alt"):
        out[name] = _query(ordered, "SELECT policy_id, churn_label, true AS is_probability FROM tested")
    out["compare_models"] = _query(ordered, """
SELECT m.model, count(*) AS n_test, CAST(sum(churn_label) AS BIGINT) AS n_churned, true AS in_range, true AS brier_fits
FROM tested, (VALUES ('baseline'), ('boosted'), ('alternative')) AS m(model) GROUP BY m.model""")
    out["tree_contributions"] = _query(
        ordered, "SELECT policy_id, CAST(34 AS BIGINT) AS n_features, true AS adds_up FROM tested")
    out["gbt_first_tree"] = _first_tree(ordered)
    names = [
        "n_estimators", "max_depth", "learning_rate", "subsample", "colsample", "min_child_weight", "reg_alpha", "reg_lambda",
        "scale_pos_weight", "cv_auc"]
    out["search_gbt"] = f"""
SELECT CAST(trial AS INTEGER) AS trial, unnest({names}) AS name, true AS in_range FROM range(50) AS t(trial)
UNION ALL SELECT 50, 'best_cv_auc', true"""
    ranked = ["auc_roc", "avg_precision", "brier_score"]
    out["train_job"] = f"""
SELECT 'logistic_baseline' AS run_name, unnest({ranked}) AS metric, true AS in_range
UNION ALL SELECT 'boosted_search', unnest({ranked + ["cv_auc_best", "lift_at_15pct", "recall_at_15pct", "precision_at_15pct"]}), true"""
    out["score_model"] = _query(POLICIES, "SELECT policy_id, true AS is_probability, true AS keeps_order FROM policies")
    out["eval_job"] = "SELECT CAST(0.7 AS DOUBLE) AS min_auc, true AS is_auc, true AS gate_fits"

    # Attribution.
    explained = POLICIES + "," + _contributions("policies")
    out["contributions"] = _query(explained, f"SELECT policy_id, feature, {_r6('value', 'contribution')} FROM contributions")
    out["importance"] = _query(explained, """
SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution FROM contributions GROUP BY feature""")
    out["explain_extremes"] = _query(SCORES + "," + _contributions("scores") + """,
picked AS (
  (SELECT 'highest' AS extreme, policy_id, churn_probability FROM scores ORDER BY churn_probability DESC, policy_id LIMIT 1)
  UNION ALL
  (SELECT 'lowest', policy_id, churn_probability FROM scores ORDER BY churn_probability, policy_id LIMIT 1))""", f"""
SELECT extreme, policy_id, churn_probability, feature, {_r6('value', 'contribution')}
FROM picked JOIN contributions USING (policy_id)""")
    out["dependence"] = _query(explained, """
SELECT feature, CASE WHEN feature = 'tenure_months' THEN floor(value / CAST(6 AS DOUBLE)) * 6 ELSE value END AS value,
  count(*) AS n, round(avg(contribution), 6) AS mean_contribution
FROM contributions WHERE feature IN ('tenure_months', 'claim_count_12m') GROUP BY 1, 2""")
    derived_cells = _melt("features", ["premium_to_market_ratio", "tenure_years", "has_recent_claim"])
    out["dependence_default"] = _query(FEATURES + f""",
cells AS (SELECT "column" AS feature, v AS value FROM ({derived_cells})),
means AS (SELECT feature, avg(value) AS m FROM cells GROUP BY feature),
parts AS (
  SELECT feature, value, CASE feature WHEN 'premium_to_market_ratio' THEN CAST(0.8 AS DOUBLE)
    WHEN 'tenure_years' THEN CAST(-0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * (value - m) AS contribution
  FROM cells JOIN means USING (feature))""", """
SELECT feature, round(CASE feature WHEN 'premium_to_market_ratio' THEN floor(value / CAST(0.25 AS DOUBLE)) * CAST(0.25 AS DOUBLE)
  WHEN 'tenure_years' THEN floor(value / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) ELSE value END, 6) AS value,
  count(*) AS n, round(avg(contribution), 6) AS mean_contribution
FROM parts GROUP BY 1, 2""")
    return out
