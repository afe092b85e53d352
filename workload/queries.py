"""One callable (spark, sf_dir) -> DataFrame per operator."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from policylens.functions.tiers import retention_action, risk_tier
from policylens.functions.value import lifetime_value
from policylens.operators import attribution, drift, evaluation, features, modeling, profile, ranking, scoring
from policylens.operators import translate as translation
from policylens.operators import tree_attribution, validate
from policylens.plans.batch_score import batch_score
from policylens.plans.drift import drift_job
from policylens.plans.evaluate import eval_job
from policylens.plans.features import build_training_features
from policylens.plans.ingest import ingest
from policylens.plans.train import compare_models as compare_fitted
from policylens.plans.train import train_job
from policylens.schema import LABEL, RAW_COLUMNS, RAW_TARGET, numeric_columns
from policylens.sources import contracts, policies as policy_files, reports, state as states
from policylens.sources.staging import new_path, stage
from policylens.streaming.portfolio_stream import portfolio_stream, portfolio_total
from policylens.streaming.score_stream import read_stream, score_stream
from workload import inputs

SCORE = "churn_probability"
MODEL_NAME, MODEL_STAGE = "retention_scorecard", "Production"


def _r6(column, name=None):
    return F.round(F.col(column), 6).alias(name or column)


def _rounded(df, *columns):
    return df.select(*[_r6(c) if c in columns else F.col(c) for c in df.columns])


# ---- sources and sinks ----


def src_contract_tsv(spark, sf_dir):
    raw = inputs.raw_contracts(spark, sf_dir)
    path = inputs.write_lines(inputs.contract_lines(raw), new_path(spark, "contracts"))
    return contracts.read_contracts(spark, path)


def attach_by_position(spark, sf_dir):
    raw = inputs.raw_contracts(spark, sf_dir)
    body = inputs.write_lines(inputs.contract_lines(raw, RAW_COLUMNS[:-1]), new_path(spark, "body"))
    target = inputs.write_lines(inputs.contract_lines(raw, [RAW_TARGET]), new_path(spark, "target"))
    joined = contracts.attach_by_position(
        contracts.read_contracts(spark, body, with_target=False), contracts.read_targets(spark, target))
    return joined.select("row_no", "PPERSAUT", "PBRAND", "MAANTHUI", "MGEMLEEF", "MKOOPKLA", RAW_TARGET)


def ingest_files(spark, sf_dir):
    """The whole ingest job from files: every fifth customer goes to the test file."""
    raw = inputs.raw_contracts(spark, sf_dir)
    held_out = F.col("client_no") % 5 == 4
    train = inputs.write_lines(inputs.contract_lines(raw.where(~held_out)), new_path(spark, "train"))
    test_raw = raw.where(held_out)
    test = inputs.write_lines(inputs.contract_lines(test_raw, RAW_COLUMNS[:-1]), new_path(spark, "test"))
    target = inputs.write_lines(inputs.contract_lines(test_raw, [RAW_TARGET]), new_path(spark, "target"))
    summary = ingest(spark, train, test, target, new_path(spark, "out"), new_path(spark, "out"))
    return _rounded(summary, "positive_rate")


def scan_policies(spark, sf_dir):
    path = policy_files.write_table(inputs.policies(spark, sf_dir), new_path(spark, "policies"))
    return policy_files.read_policies(spark, path)


def sink_policies(spark, sf_dir):
    parts = ranking.split_ordered(inputs.policies(spark, sf_dir))
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    paths = policy_files.write_policies(train, test, new_path(spark, "train"), new_path(spark, "test"))
    stored = [
        policy_files.read_policies(spark, path).select(
            F.lit(name).alias("dataset"), "policy_id", "annual_premium", LABEL)
        for name, path in zip(("train", "test"), paths)]
    return stored[0].unionByName(stored[1])


def sink_features(spark, sf_dir):
    source = policy_files.write_table(inputs.policies(spark, sf_dir), new_path(spark, "policies"))
    path = new_path(spark, "matrix")
    build_training_features(spark, source, path)
    return _matrix(spark.read.parquet(path))


def state_fallback(spark, sf_dir):
    missing = states.load_market_state(spark, new_path(spark, "never-written"))
    df = features.add_features(inputs.policies(spark, sf_dir), missing, ["premium"])
    return df.select("policy_id", "premium_to_market_ratio", "is_overpriced")


def run_log(spark, sf_dir):
    path = new_path(spark, "runs")
    for name, card in (("scorecard", inputs.scorecard), ("tenure_card", inputs.tenure_card)):
        scored = card(inputs.policies(spark, sf_dir))
        row = evaluation.curve_metrics(evaluation.score_curve(scored)).first()
        reports.append_run(spark, path, name, {"model_type": name}, {
            "auc_roc": round(row["auc"], 6), "avg_precision": round(row["avg_precision"], 6)})
    return reports.read_runs(spark, path).select("run_name", "kind", "name", "value")


def load_summary(spark, sf_dir):
    return _rounded(
        policy_files.load_summary(inputs.policies(spark, sf_dir), "policies"), "positive_rate")


# ---- translation ----


def _translated(*columns):
    def query(spark, sf_dir):
        return inputs.build_policies(spark, sf_dir).select(*columns)
    return query


def tr_premium_change(spark, sf_dir):
    """The hashed noise of the default translation."""
    df = translation.translate(inputs.raw_contracts(spark, sf_dir), "client_no")
    return df.select("policy_id", "tenure_months", "premium_change_pct", "last_contact_days")


# ---- validation ----


def _checked(spark, sf_dir):
    return validate.check(inputs.dirty_requests(spark, sf_dir))


def validate_rules(spark, sf_dir):
    return _checked(spark, sf_dir).select("client_no", F.array_join("reasons", ",").alias("reasons"))


def normalize_lob(spark, sf_dir):
    return validate.normalize_lob(inputs.dirty_requests(spark, sf_dir)).select("client_no", "lob")


def apply_defaults(spark, sf_dir):
    return validate.apply_defaults(inputs.sparse_requests(spark, sf_dir)).select(
        "policy_id", "renewal_count", "days_to_settle_avg", "claim_settled_pct", "policy_count_active",
        "last_contact_days")


def fill_last_contact(spark, sf_dir):
    return validate.fill_last_contact(inputs.sparse_requests(spark, sf_dir)).select(
        "policy_id", "last_contact_days")


def validate_types(spark, sf_dir):
    """Fields that come as text: what does not parse, whole numbers with a fraction, and every bound."""
    checked = validate.check(inputs.texted_requests(spark, sf_dir))
    return checked.select(
        "client_no", F.array_join("reasons", ",").alias("reasons"), "tenure_months", "claim_count_12m", "insured_age",
        F.when(~F.isnan("premium_change_pct"), F.col("premium_change_pct")).alias("premium_change_pct"))


def validate_reject(spark, sf_dir):
    """Missing cells are refused instead of filled; absent columns still get their defaults."""
    checked = validate.check(inputs.sparse_requests(spark, sf_dir), null_policy="reject")
    return checked.select("client_no", F.array_join("reasons", ",").alias("reasons"), "renewal_count", "policy_count_active")


def validate_split(spark, sf_dir):
    checked = _checked(spark, sf_dir)
    good = validate.valid_rows(checked).select(
        F.lit("valid").alias("status"), "client_no", "policy_id", "lob", "annual_premium",
        "insured_age", "last_contact_days")
    bad = validate.rejected_rows(checked).select(
        F.lit("rejected").alias("status"), "client_no", "policy_id", "lob",
        F.when(~F.isnan("annual_premium"), F.col("annual_premium")).alias("annual_premium"),
        "insured_age", "last_contact_days")
    return good.unionByName(bad)


def reject_counts(spark, sf_dir):
    return validate.reject_counts(_checked(spark, sf_dir))


# ---- fit and features ----


def fit_market(spark, sf_dir):
    return features.fit_market(inputs.policies(spark, sf_dir))


def market_medians(spark, sf_dir):
    return profile.market_medians(inputs.market_state(spark, sf_dir))


def _feature_group(group, *columns):
    def query(spark, sf_dir):
        df = features.add_features(
            inputs.policies(spark, sf_dir), inputs.market_state(spark, sf_dir), [group])
        return _r_floats(df.select("policy_id", *columns))
    return query


def _r_floats(df):
    return df.select(*[
        _r6(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _matrix(df):
    return _r_floats(df)


def feature_matrix(spark, sf_dir):
    return _matrix(features.build_feature_matrix(inputs.policies(spark, sf_dir), keep=["policy_id"]))


def training_features(spark, sf_dir):
    return _matrix(features.training_features(inputs.policies(spark, sf_dir)))


def inference_features(spark, sf_dir):
    """Medians learned on one part of the customers, used on the rest."""
    df = inputs.policies(spark, sf_dir)
    known = inputs.client_no() % 10 < 7
    state = stage(features.fit_market(df.where(known)), "state")
    return _matrix(features.inference_features(df.where(~known).drop(LABEL), state))


def feature_catalog(spark, sf_dir):
    return _r_floats(features.feature_catalog(
        inputs.requests(spark, sf_dir), inputs.market_state(spark, sf_dir)))


# ---- order and splits ----


def global_rank(spark, sf_dir):
    ranked = ranking.global_rank(inputs.scores(spark, sf_dir).select("policy_id", SCORE), [(SCORE, "desc"), "policy_id"])
    return ranked.select("policy_id", "rn")


def rank_lines(spark, sf_dir):
    """Rank of every order line by price, lines of equal keys numbered together by group size."""
    lines = inputs.line_scores(spark, sf_dir, fine=True)
    groups = lines.groupBy(SCORE, *inputs.LINE_KEY).agg(F.count(F.lit(1)).alias("n"))
    order = [(SCORE, "desc"), *inputs.LINE_KEY]
    return ranking.prefix_sums(groups, order, {"last_rank": "n"}).select(*inputs.LINE_KEY, SCORE, "n", "last_rank")


def split_ordered(spark, sf_dir):
    return ranking.split_ordered(inputs.policies(spark, sf_dir)).select("policy_id", "part")


def split_wide_ids(spark, sf_dir):
    """Ids on both sides of the border from seven to eight digits."""
    df = inputs.policies(spark, sf_dir)
    wide = df.withColumn("policy_id", F.concat(F.lit("POL"), (inputs.client_no() + 9_999_900).cast("string")))
    return ranking.split_ordered(wide).select("policy_id", "part")


def split_missing(spark, sf_dir):
    """Tenures of which two in five are missing; the border lies among them."""
    df = _with_missing(inputs.policies(spark, sf_dir), "tenure_months")
    return ranking.split_ordered(df, ["tenure_months", "policy_id"], 0.7).select("policy_id", "part")


def _with_missing(df, column):
    return df.withColumn(column, F.when(inputs.client_no() % 5 > 1, F.col(column)))


def split_by_tenure(spark, sf_dir):
    return ranking.split_ordered(
        inputs.policies(spark, sf_dir), [("tenure_months", "desc"), "policy_id"], 0.7
    ).select("policy_id", "part")


def time_folds(spark, sf_dir):
    return ranking.time_folds(inputs.policies(spark, sf_dir).select("policy_id")).select(
        "policy_id", "fold", "role")


# ---- profiles ----


def profile_nulls(spark, sf_dir):
    return profile.null_profile(inputs.sparse_requests(spark, sf_dir))


def head_rows(spark, sf_dir):
    return profile.head_rows(inputs.policies(spark, sf_dir))


def profile_describe(spark, sf_dir):
    return _r_floats(profile.describe(inputs.policies(spark, sf_dir)))


def target_distribution(spark, sf_dir):
    return _rounded(profile.target_distribution(inputs.policies(spark, sf_dir)), "share")


def hist_by_class(spark, sf_dir):
    return _r_floats(profile.histogram_by_class(inputs.policies(spark, sf_dir)))


def hist_derived(spark, sf_dir):
    """The same bins over the derived columns."""
    base = inputs.policies(spark, sf_dir)
    df = features.add_features(base, inputs.market_state(spark, sf_dir))
    derived = [c for c in df.columns if c not in base.columns]
    return _r_floats(profile.histogram_by_class(df, derived))


def corr_matrix(spark, sf_dir):
    return _rounded(profile.correlation_matrix(inputs.policies(spark, sf_dir)), "correlation")


def corr_with_label(spark, sf_dir):
    base = inputs.policies(spark, sf_dir)
    df = features.add_features(base, inputs.market_state(spark, sf_dir))
    derived = [c for c in df.columns if c not in base.columns]
    return _rounded(profile.correlation_with_label(df, derived), "correlation")


def _rate_by(category):
    def query(spark, sf_dir):
        return _rounded(profile.rate_by(inputs.policies(spark, sf_dir), category), "rate")
    return query


def premium_tenure_grid(spark, sf_dir):
    return profile.premium_tenure_grid(inputs.policies(spark, sf_dir))


# ---- scoring ----


def tier_batch(spark, sf_dir):
    return inputs.scores(spark, sf_dir).select(
        "policy_id", SCORE, risk_tier(F.col(SCORE), closed="right").alias("risk_tier"))


def tier_online(spark, sf_dir):
    return inputs.scores(spark, sf_dir).select(
        "policy_id", SCORE, risk_tier(F.col(SCORE), closed="left").alias("risk_tier"))


def tier_edges(spark, sf_dir):
    """Both rules on the line scores, which hit the edges and leave [0, 1]."""
    lines = inputs.line_scores(spark, sf_dir).withColumn(SCORE, F.round(F.col(SCORE) * 2 - 0.05, 2))
    p = F.col(SCORE)
    return lines.groupBy(
        SCORE, risk_tier(p, closed="right").alias("batch_tier"), risk_tier(p, closed="left").alias("online_tier"),
    ).agg(F.count(F.lit(1)).alias("n"))


def retention(spark, sf_dir):
    tier = risk_tier(F.col(SCORE), closed="left")
    return inputs.scores(spark, sf_dir).select(
        "policy_id", tier.alias("risk_tier"), retention_action(tier).alias("recommended_action"))


def clv(spark, sf_dir):
    return inputs.policies(spark, sf_dir).select(
        "policy_id", lifetime_value(F.col("annual_premium"), F.col("tenure_months")).alias("estimated_clv"))


def prediction_rows(spark, sf_dir):
    return scoring.prediction_rows(inputs.scores(spark, sf_dir), MODEL_NAME, MODEL_STAGE)


def batch_result(spark, sf_dir):
    return scoring.batch_result(inputs.scores(spark, sf_dir), rank=True)


def at_risk_summary(spark, sf_dir):
    return scoring.at_risk_summary(inputs.repeated_requests(spark, sf_dir))


def _streamed(spark, sf_dir, requests, scorer, n_files=6):
    """Paths of the scores, summaries and rejects of requests that arrive as files."""
    source, scores, summary, rejects, progress = (
        new_path(spark, n) for n in ("requests", "scores", "summary", "rejects", "progress"))
    requests.repartition(n_files).write.parquet(source)
    score_stream(read_stream(spark, source, files_per_batch=2), scorer, scores, summary, progress, rejects).awaitTermination()
    return scores, summary, rejects


def _read_batches(spark, schema, path):
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def stream_scores(spark, sf_dir):
    """The dirty requests as a stream of files; what is valid gets its features under static medians and is scored."""
    state = inputs.market_state(spark, sf_dir)

    def scorer(batch):
        return inputs.scorecard(features.add_features(batch, state)).select(*batch.columns, SCORE)

    scores, _, _ = _streamed(spark, sf_dir, inputs.dirty_requests(spark, sf_dir).drop("client_no"), scorer)
    return _read_batches(spark, "policy_id string, churn_probability double, risk_tier string", scores)


def stream_rejects(spark, sf_dir):
    """The records the stream refuses, counted by their broken fields."""
    _, _, rejects = _streamed(
        spark, sf_dir, inputs.dirty_requests(spark, sf_dir).drop("client_no"), inputs.scorecard)
    return _read_batches(spark, "reasons array<string>", rejects).groupBy(
        F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def stream_summary(spark, sf_dir):
    """Requests at risk and their premiums over the batches of the stream."""
    _, summary, _ = _streamed(spark, sf_dir, inputs.requests(spark, sf_dir), inputs.scorecard)
    schema = "total_at_risk long, total_premium_at_risk double"
    return _read_batches(spark, schema, summary).agg(
        F.sum("total_at_risk").alias("total_at_risk"), F.round(F.sum("total_premium_at_risk"), 2).alias("total_premium_at_risk"))


def stream_summary_total(spark, sf_dir):
    """The portfolio over three deliveries with repeated policies, the last of them after a restart."""
    source, entries, progress = (new_path(spark, n) for n in ("requests", "entries", "progress"))
    rows = inputs.repeated_requests(spark, sf_dir).drop(SCORE, LABEL)
    again, number = F.col("pos") >= 1_000_000_000, inputs.client_no()
    delivered = F.when(again, F.when(number % 100 == 0, 3).otherwise(2)).otherwise(1 + number % 2)
    for number in (1, 2, 3):
        delivery = rows.where(delivered == number).coalesce(1).sortWithinPartitions("pos").drop("pos")
        delivery.write.parquet(f"{source}/delivery={number}")
        if number > 1:  # the first run finds two deliveries, the second goes on with the third
            stream = read_stream(spark, f"{source}/*", files_per_batch=1)
            portfolio_stream(stream, inputs.scorecard, entries, progress).awaitTermination()
    return portfolio_total(spark, entries)


# ---- evaluation ----


def _topk(fraction):
    def query(spark, sf_dir):
        return evaluation.topk_metrics(inputs.scores(spark, sf_dir), [fraction])
    return query


def topk_missing(spark, sf_dir):
    """Cuts before, at and inside scores that are missing."""
    return evaluation.captured_at(_with_missing(inputs.scores(spark, sf_dir), SCORE), [0.1, 0.5, 0.7, 0.9])


def lift_missing(spark, sf_dir):
    return _r_floats(evaluation.lift_table(_with_missing(inputs.scores(spark, sf_dir), SCORE)))


def topk_lines(spark, sf_dir):
    """Several cuts through heavily tied scores."""
    return evaluation.captured_at(
        inputs.line_scores(spark, sf_dir), [0.1, 0.15, 0.29, 0.5], ids=inputs.LINE_KEY)


def topk_lines_fine(spark, sf_dir):
    return evaluation.captured_at(
        inputs.line_scores(spark, sf_dir, fine=True), [0.1, 0.15, 0.29, 0.5], ids=inputs.LINE_KEY)


def gains_curve(spark, sf_dir):
    return _r_floats(evaluation.gains_curve(inputs.scores(spark, sf_dir)))


def lift_table(spark, sf_dir):
    return _r_floats(evaluation.lift_table(inputs.scores(spark, sf_dir)))


def roc_points(spark, sf_dir):
    return _r_floats(evaluation.roc_points(evaluation.score_curve(inputs.scores(spark, sf_dir))))


def _curve_metric(metric, source):
    def query(spark, sf_dir):
        return _r_floats(evaluation.curve_metrics(evaluation.score_curve(source(spark, sf_dir))).select(metric))
    return query


def _fine_lines(spark, sf_dir):
    return inputs.line_scores(spark, sf_dir, fine=True)


def brier(spark, sf_dir):
    return _r_floats(evaluation.brier(inputs.scores(spark, sf_dir)))


def calibration(spark, sf_dir):
    return _r_floats(evaluation.calibration_table(inputs.scores(spark, sf_dir)))


def eval_report(spark, sf_dir):
    return evaluation.evaluation_report(inputs.scores(spark, sf_dir))


def quality_gate(spark, sf_dir):
    return evaluation.quality_gate(evaluation.evaluation_report(inputs.scores(spark, sf_dir)))


def model_comparison(spark, sf_dir):
    base = inputs.policies(spark, sf_dir).select(
        "tenure_months", "claim_count_12m", "premium_change_pct", LABEL)
    both = inputs.scorecard(base).withColumn("model", F.lit("scorecard")).unionByName(
        inputs.tenure_card(base).withColumn("model", F.lit("tenure_card")))
    return _r_floats(evaluation.model_comparison(both))


# ---- monitoring ----


def ks_columns(spark, sf_dir):
    reference, current = inputs.drift_sides(spark, sf_dir, inputs.client_no() % 10 < 7)
    return _r_floats(drift.ks_columns(reference, current))


def ks_events(spark, sf_dir):
    """Event values before and from a date, one test per event type."""
    events = inputs.table(spark, sf_dir, "events")
    types = sorted(r[0] for r in events.select("event_type").where(F.col("event_type").isNotNull()).distinct().collect())
    wide = events.select("ts", *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in types])
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return _r_floats(drift.ks_columns(wide.where(early).drop("ts"), wide.where(~early).drop("ts")))


def drift_summary(spark, sf_dir):
    reference, current = inputs.drift_sides(spark, sf_dir, F.col("tenure_months") > 35)
    numeric = len(numeric_columns(reference, exclude=[LABEL]))
    summary = drift.drift_summary(drift.ks_columns(reference, current), numeric)
    return _r_floats(summary.withColumn("drifted_columns", F.array_join("drifted_columns", ",")))


def chi2_columns(spark, sf_dir):
    reference, current = inputs.drift_sides(spark, sf_dir, inputs.client_no() % 10 < 7)
    return _r_floats(drift.chi2_columns(reference, current))


def drift_report(spark, sf_dir):
    reference, current = inputs.drift_sides(spark, sf_dir, F.col("tenure_months") > 35)
    return _r_floats(drift.drift_report(reference, current).drop("timestamp"))


def drift_job_report(spark, sf_dir):
    """The monitoring job on two stored tables, read back from the report it writes."""
    sides = [
        policy_files.write_table(side, new_path(spark, "side"))
        for side in inputs.drift_sides(spark, sf_dir, F.col("tenure_months") > 35)]
    out = new_path(spark, "monitoring")
    drift_job(spark, *sides, out, scorer=inputs.scorecard, timestamp="now")
    report = spark.read.json(f"{out}/drift").select(
        "share_drifted_features", "dataset_drift_detected", F.col("alert").alias("data_alert"), "n_reference", "n_current")
    performance = spark.read.json(f"{out}/auc").select("baseline_auc", "current_auc", "alert", "recommendation")
    # Two reports of one row each, side by side.
    both = report.unionByName(performance, allowMissingColumns=True)
    return _r_floats(both.agg(*[F.max(c).alias(c) for c in both.columns]))


def auc_drift(spark, sf_dir):
    """AUC per line of business on either side of the customer base."""
    scored = inputs.scores(spark, sf_dir)
    known = inputs.client_no() % 10 < 7
    aucs = [
        evaluation.curve_metrics(evaluation.score_curve(part, by=["lob"]), ["lob"])
        .select("lob", F.round("auc", 6).alias(name))
        for part, name in ((scored.where(known), "baseline_auc"), (scored.where(~known), "current_auc"))]
    return _r_floats(drift.auc_drift(aucs[0].join(aucs[1], "lob")))


def model_card_facts(spark, sf_dir):
    scored = inputs.scores(spark, sf_dir)
    parts = ranking.split_ordered(scored)
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    ranked = evaluation.curve_metrics(evaluation.score_curve(test)).select(
        F.lit("auc_roc").alias("name"), F.col("auc").alias("value"))
    top = evaluation.topk_metrics(test, [0.10]).select(F.inline(F.array(
        F.struct(F.lit("precision_at_10").alias("name"), F.col("precision").alias("value")),
        F.struct(F.lit("recall").alias("name"), F.col("recall").alias("value")))))
    weights = attribution.importance(attribution.contributions(test, inputs.SCORECARD_WEIGHTS))
    return _r_floats(drift.model_card_facts(
        train, test, ranked.unionByName(top), weights.withColumnRenamed("mean_abs_contribution", "value")))


# ---- attribution ----


def _scorecard_contributions(spark, sf_dir):
    return attribution.contributions(inputs.policies(spark, sf_dir), inputs.SCORECARD_WEIGHTS)


def contributions(spark, sf_dir):
    return _r_floats(_scorecard_contributions(spark, sf_dir))


def importance(spark, sf_dir):
    return _r_floats(attribution.importance(_scorecard_contributions(spark, sf_dir)))


def explain_extremes(spark, sf_dir):
    return _r_floats(attribution.explain_extremes(
        inputs.scores(spark, sf_dir), inputs.SCORECARD_WEIGHTS, SCORE))


def dependence(spark, sf_dir):
    return _r_floats(attribution.dependence(
        _scorecard_contributions(spark, sf_dir), ["tenure_months", "claim_count_12m"], {"tenure_months": 6}))


def dependence_default(spark, sf_dir):
    """The default features under a linear score of the derived columns."""
    df = features.add_features(inputs.policies(spark, sf_dir), inputs.market_state(spark, sf_dir))
    rows = attribution.contributions(df, inputs.DERIVED_WEIGHTS)
    return _r_floats(attribution.dependence(rows, bin_widths={"premium_to_market_ratio": 0.25, "tenure_years": 0.5}))


# ---- models ----

# The stated single configuration of the boosted trees.
STATED_TREES = {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.05}


def _model_parts(spark, sf_dir):
    """(train, test, features) with the derived columns, medians from the train part."""
    def build(session, folder):
        parts = ranking.split_ordered(validate.fill_last_contact(inputs.policies(session, folder)))
        state = stage(features.fit_market(parts.where(F.col("part") == "train")), "state")
        return features.add_features(parts, state)
    parts = inputs.stored(spark, sf_dir, "model_parts", build)
    names = [c for c in features.feature_columns(parts) if c != "part"]
    return (parts.where(F.col("part") == "train").drop("part"),
            parts.where(F.col("part") == "test").drop("part"), names)


def _scored_test(model, test, column="probability"):
    return modeling.positive_probability(model, test, column).select("policy_id", LABEL, SCORE)


def train_baseline(spark, sf_dir):
    """The baseline's gradient by its intercept: the weighted sum of probability minus label over the train rows is zero."""
    train, test, names = _model_parts(spark, sf_dir)
    model = modeling.train_baseline(train, names)
    weighted, _ = modeling.with_balanced_weight(train)
    scored = modeling.positive_probability(model, weighted)
    tested = _scored_test(model, test).agg(
        F.count(F.lit(1)).alias("n_test"), F.min(SCORE).alias("low"), F.max(SCORE).alias("high")).first()
    return scored.agg(
        F.round(F.abs(F.sum(F.col("_weight") * (F.col(SCORE) - F.col(LABEL))) / F.sum("_weight")), 3).alias("gradient"),
        F.count(F.lit(1)).alias("n_train")).select(
        "gradient", "n_train", F.lit(tested["n_test"]).cast("long").alias("n_test"),
        F.lit(tested["low"] >= 0 and tested["high"] <= 1).alias("are_probabilities"))


def _probabilities(scored):
    """Facts of scored rows that SQL can state: each has a probability."""
    return scored.select("policy_id", LABEL, F.coalesce(F.col(SCORE).between(0, 1), F.lit(False)).alias("is_probability"))


def train_gbt(spark, sf_dir):
    train, test, names = _model_parts(spark, sf_dir)
    params = {**STATED_TREES, "subsample": 0.8, "colsample": 0.8, "scale_pos_weight": 3.0}
    return _probabilities(_scored_test(modeling.train_boosted(train, names, params), test))


def train_gbt_alt(spark, sf_dir):
    train, test, names = _model_parts(spark, sf_dir)
    params = {**modeling.ALTERNATIVE, "scale_pos_weight": "balanced"}
    return _probabilities(_scored_test(modeling.train_boosted(train, names, params), test))


def compare_models(spark, sf_dir):
    """Three fitted models side by side on the test rows, and whether the mean squared error of a model's stored scores is
    the Brier score stated for it."""
    train, test, names = _model_parts(spark, sf_dir)
    scores, compared = compare_fitted(train, test, names, {**STATED_TREES, "scale_pos_weight": 3.0}, new_path(spark, "compared"))
    error = F.col(SCORE) - F.col(LABEL)
    counted = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col(LABEL).cast("long")).alias("n_churned"), F.avg(error * error).alias("error"))
    ranges = F.col("auc").between(0, 1) & F.col("avg_precision").between(0, 1)
    return counted.join(compared, "model").select(
        "model", "n_test", "n_churned", ranges.alias("in_range"), (F.abs(F.col("error") - F.col("brier")) < 1e-9).alias("brier_fits"))


# A first tree small enough to be grown in SQL as well.
FIRST_TREE = {
    "n_estimators": 1, "max_depth": 2, "learning_rate": 0.3, "reg_alpha": 3.0, "reg_lambda": 2.0, "min_child_weight": 5,
    "scale_pos_weight": 3.0}
FIRST_TREE_FEATURES = [
    "tenure_months", "claim_count_12m", "insured_age", "premium_change_pct", "last_contact_days", "policy_count_active"]


def gbt_first_tree(spark, sf_dir):
    """The margin of every training row after one tree with leaf penalties."""
    train, _, _ = _model_parts(spark, sf_dir)
    model = modeling.train_boosted(train, FIRST_TREE_FEATURES, FIRST_TREE)
    margin = vector_to_array("rawPrediction")[1]
    return model.transform(train).select("policy_id", F.round(margin, 9).alias("margin"))


def tree_contributions(spark, sf_dir):
    """Contributions of the stated trees for every test row: one for each feature, and with the base they add up to the margin."""
    train, test, names = _model_parts(spark, sf_dir)
    model = modeling.train_boosted(train, names, {**STATED_TREES, "scale_pos_weight": 3.0})
    ensemble = modeling.boosted_ensemble(model)
    summed = tree_attribution.tree_contributions(test, ensemble).groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("contribution").alias("earned"))
    margins = model.transform(test).select("policy_id", vector_to_array("rawPrediction")[1].alias("margin"))
    gap = F.abs(F.col("earned") + F.lit(tree_attribution.base_value(ensemble)) - F.col("margin"))
    return summed.join(margins, "policy_id").select("policy_id", "n_features", (gap < 1e-9).alias("adds_up"))


def search_gbt(spark, sf_dir):
    """Every parameter and score of every trial, and whether it lies in its range."""
    train, _, names = _model_parts(spark, sf_dir)
    found = modeling.search_boosted(train, names)
    limits = {name: (low, high) for name, (low, high, _) in modeling.SEARCH_SPACE.items()} | {"cv_auc": (0.0, 1.0)}
    rows = [(i, name, value is not None and limits[name][0] <= value <= limits[name][1])
            for i, trial in enumerate(found.trials) for name, value in trial.items()]
    rows.append((len(found.trials), "best_cv_auc", found.cv_auc == max(t["cv_auc"] for t in found.trials)))
    return spark.createDataFrame(rows, "trial int, name string, in_range boolean")


def calibrate_platt(spark, sf_dir):
    """Mean calibrated probability on the train rows beside the mean smoothed target, plain and weighted by the model's output:
    both agree, as the intercept's and the slope's gradients are zero."""
    train, _, names = _model_parts(spark, sf_dir)
    model = modeling.calibrate(modeling.train_boosted(train, names, STATED_TREES), train)
    scored = model.transform(train).select(
        LABEL, vector_to_array("calibrated")[1].alias(SCORE), vector_to_array("probability")[1].alias("output"))
    negatives, positives = modeling.class_counts(train)
    target = F.when(F.col(LABEL) == 1, (positives + 1.0) / (positives + 2.0)).otherwise(1.0 / (negatives + 2.0))
    return scored.agg(
        F.round(F.avg(SCORE), 5).alias("mean_calibrated"), F.round(F.avg(target), 5).alias("mean_target"),
        F.round(F.abs(F.avg(F.col("output") * (F.col(SCORE) - target))), 5).alias("slope_gap"))


def train_metrics(spark, sf_dir):
    """The training job: every metric of both runs, and whether it lies in its range."""
    trained = train_job(inputs.policies(spark, sf_dir), new_path(spark, "model"))
    most = F.when(F.col("metric") == "lift_at_15pct", 1 / 0.15 + 1e-9).otherwise(1.0)
    return trained.metrics.select("run_name", "metric", F.col("value").between(0, most).alias("in_range"))


def _stored_model(spark, sf_dir):
    """Folder of a stored model, medians and calibrated baseline, as the training job leaves them; one for all who score."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        train, _, names = _model_parts(spark, sf_dir)
        out = new_path(spark, "model")
        states.save_market_state(inputs.market_state(spark, sf_dir), f"{out}/market_state")
        modeling.calibrate(modeling.train_baseline(train, names), train).write().overwrite().save(f"{out}/model")
        _models[key] = out
    return _models[key]


_models = {}


def score_model(spark, sf_dir):
    """A stored model over requests: every row is scored, and the calibrated order is that of the model itself."""
    out = _stored_model(spark, sf_dir)
    model, state = PipelineModel.load(f"{out}/model"), states.load_market_state(spark, f"{out}/market_state")
    df = inputs.requests(spark, sf_dir)
    plain = scoring.score(df, state, model, "probability").select("policy_id", F.col(SCORE).alias("plain"))
    scored = scoring.score(df, state, model, "calibrated").select("policy_id", SCORE).join(plain, "policy_id")
    ends = sorted(scored.agg(F.min_by(SCORE, "plain"), F.max_by(SCORE, "plain")).first())
    return scored.select(
        "policy_id", F.col(SCORE).between(0, 1).alias("is_probability"), F.col(SCORE).between(*ends).alias("keeps_order"))


def batch_score_job(spark, sf_dir):
    """The job over requests with missing cells: every row comes back, with the tier of its probability."""
    out = _stored_model(spark, sf_dir)
    sparse = inputs.sparse_requests(spark, sf_dir).drop("client_no")
    for column in ("annual_premium", "tenure_months", "insured_age"):
        sparse = sparse.withColumn(column, F.when(inputs.client_no() % 11 != 0, F.col(column)))
    source = policy_files.write_table(sparse, new_path(spark, "requests"))
    scored = batch_score(spark, source, new_path(spark, "batch"), model_dir=out)
    return scored.select(
        "policy_id", F.col(SCORE).between(0, 1).alias("is_probability"),
        F.col("risk_tier").eqNullSafe(risk_tier(F.col(SCORE), closed="right")).alias("tier_fits"))


def eval_gate(spark, sf_dir):
    """The evaluation job over a labelled table: its gate row, and whether it follows from the AUC."""
    out = _stored_model(spark, sf_dir)
    source = policy_files.write_table(inputs.policies(spark, sf_dir), new_path(spark, "labelled"))
    gate = eval_job(spark, source, out, new_path(spark, "report"))
    return gate.select(
        "min_auc", F.col("auc_roc").between(0, 1).alias("is_auc"),
        (F.col("passed") == (F.col("auc_roc") >= F.col("min_auc"))).alias("gate_fits"))


def entry(spark, sf_dir):
    """Raw contracts to translated policies, fitted medians and price flags, summed up by line."""
    df = inputs.build_policies(spark, sf_dir)
    priced = features.add_features(df, stage(features.fit_market(df), "state"), ["premium"])
    return _r_floats(
        priced.groupBy("lob").agg(
            F.count(F.lit(1)).alias("n_policies"),
            F.avg("is_overpriced").alias("overpriced_share"),
            F.avg("premium_to_market_ratio").alias("mean_ratio"),
            F.avg(LABEL).alias("label_rate"))
    ).orderBy("lob")


QUERIES = {
    "overpriced_by_lob": entry,
    "src_contract_tsv": src_contract_tsv,
    "attach_by_position": attach_by_position,
    "ingest_files": ingest_files,
    "scan_policies": scan_policies,
    "sink_policies": sink_policies,
    "sink_features": sink_features,
    "state_fallback": state_fallback,
    "run_log": run_log,
    "load_summary": load_summary,
    "tr_policy_id": _translated("policy_id"),
    "tr_lob_argmax": _translated("policy_id", "lob"),
    "tr_premium": _translated("policy_id", "annual_premium"),
    "tr_tenure": _translated("policy_id", "tenure_months", "renewal_count"),
    "tr_premium_change": tr_premium_change,
    "tr_claims": _translated(
        "policy_id", "claim_count_12m", "claim_count_all", "claim_settled_pct", "days_to_settle_avg"),
    "tr_age": _translated("policy_id", "insured_age"),
    "tr_channel": _translated("policy_id", "channel"),
    "tr_policy_count": _translated("policy_id", "policy_count_active"),
    "translate": lambda spark, sf_dir: inputs.build_policies(spark, sf_dir),
    "validate_rules": validate_rules,
    "normalize_lob": normalize_lob,
    "apply_defaults": apply_defaults,
    "fill_last_contact": fill_last_contact,
    "validate_types": validate_types,
    "validate_reject": validate_reject,
    "validate_split": validate_split,
    "reject_counts": reject_counts,
    "fit_market": fit_market,
    "market_medians": market_medians,
    "feat_premium": _feature_group(
        "premium", "premium_to_market_ratio", "is_overpriced", "log_premium", "premium_increased",
        "premium_increase_gt5pct"),
    "feat_claims": _feature_group(
        "claims", "has_recent_claim", "multi_claim", "claims_per_year", "has_unsettled_claim",
        "slow_settlement"),
    "feat_loyalty": _feature_group(
        "loyalty", "tenure_years", "log_tenure", "is_new_customer", "is_loyal_customer", "never_renewed",
        "log_renewals", "long_since_contact"),
    "feat_portfolio": _feature_group("portfolio", "is_multi_line", "multi_line_discount_eligible"),
    "feat_lifecycle": _feature_group(
        "lifecycle", "age_segment_encoded", "is_young_adult", "is_online_customer", "is_broker_customer"),
    "feature_matrix": feature_matrix,
    "training_features": training_features,
    "inference_features": inference_features,
    "feature_catalog": feature_catalog,
    "global_rank": global_rank,
    "rank_lines": rank_lines,
    "split_ordered": split_ordered,
    "split_by_tenure": split_by_tenure,
    "split_wide_ids": split_wide_ids,
    "split_missing": split_missing,
    "time_folds": time_folds,
    "profile_nulls": profile_nulls,
    "head_rows": head_rows,
    "profile_describe": profile_describe,
    "target_distribution": target_distribution,
    "hist_by_class": hist_by_class,
    "hist_derived": hist_derived,
    "corr_matrix": corr_matrix,
    "corr_with_label": corr_with_label,
    "rate_by_lob": _rate_by("lob"),
    "rate_by_channel": _rate_by("channel"),
    "premium_tenure_grid": premium_tenure_grid,
    "tier_batch": tier_batch,
    "tier_online": tier_online,
    "tier_edges": tier_edges,
    "retention_action": retention,
    "clv": clv,
    "prediction_rows": prediction_rows,
    "batch_result": batch_result,
    "at_risk_summary": at_risk_summary,
    "stream_score": stream_scores,
    "stream_rejects": stream_rejects,
    "stream_summary": stream_summary,
    "stream_summary_total": stream_summary_total,
    "topk_10": _topk(0.10),
    "topk_15": _topk(0.15),
    "topk_missing": topk_missing,
    "lift_missing": lift_missing,
    "topk_lines": topk_lines,
    "topk_lines_fine": topk_lines_fine,
    "gains_curve": gains_curve,
    "lift_table": lift_table,
    "roc_points": roc_points,
    "auc": _curve_metric("auc", inputs.scores),
    "auc_lines": _curve_metric("auc", inputs.line_scores),
    "auc_lines_fine": _curve_metric("auc", _fine_lines),
    "avg_precision": _curve_metric("avg_precision", inputs.scores),
    "avg_precision_lines_fine": _curve_metric("avg_precision", _fine_lines),
    "brier": brier,
    "calibration": calibration,
    "eval_report": eval_report,
    "quality_gate": quality_gate,
    "model_comparison": model_comparison,
    "ks_columns": ks_columns,
    "ks_events": ks_events,
    "drift_summary": drift_summary,
    "chi2_columns": chi2_columns,
    "drift_report": drift_report,
    "drift_job": drift_job_report,
    "auc_drift": auc_drift,
    "model_card_facts": model_card_facts,
    "contributions": contributions,
    "importance": importance,
    "explain_extremes": explain_extremes,
    "dependence": dependence,
    "dependence_default": dependence_default,
    "train_baseline": train_baseline,
    "train_gbt": train_gbt,
    "train_gbt_alt": train_gbt_alt,
    "compare_models": compare_models,
    "gbt_first_tree": gbt_first_tree,
    "tree_contributions": tree_contributions,
    "search_gbt": search_gbt,
    "calibrate_platt": calibrate_platt,
    "train_job": train_metrics,
    "score_model": score_model,
    "batch_score": batch_score_job,
    "eval_job": eval_gate,
}
