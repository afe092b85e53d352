import json
import os
import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tables import MEDIUM, rows
from policylens.operators import modeling as md
from policylens.operators import scoring
from policylens.operators.scoring import batch_result
from policylens.plans import train as train_plan
from policylens.plans.batch_score import batch_score
from policylens.plans.drift import drift_job
from policylens.plans.evaluate import eval_job
from policylens.plans.ingest import ingest
from policylens.plans.train import train_job
from policylens.schema import LABEL, RAW_COLUMNS, RAW_TARGET
from policylens.sources import contracts, reports, staging, state
from policylens.sources.policies import read_policies, write_table
from policylens.streaming.portfolio_stream import portfolio_stream, portfolio_total
from policylens.streaming.score_stream import read_stream, score_stream
from workload import inputs


def write_file(path, lines):
    with open(path, "w") as out:
        out.writelines("\t".join(map(str, line)) + "\n" for line in lines)
    return str(path)


def contract_line(i, width=86):
    return [(i * 7 + j) % 10 for j in range(width - 1)] + [i % 2] if width == 86 else [
        (i * 7 + j) % 10 for j in range(width)]


def test_rows_are_numbered_across_blocks_and_files(spark, tmp_path):
    folder = tmp_path / "targets"
    folder.mkdir()
    write_file(folder / "part-00000.txt", [[i] for i in range(9000)])
    write_file(folder / "part-00001.txt", [[i] for i in range(9000, 30000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        scan = contracts.read_targets(spark, str(folder))
        assert scan.rdd.getNumPartitions() > 8
        numbered = contracts.with_row_number(scan)
        assert numbered.where(F.col("row_no") != F.col(RAW_TARGET)).count() == 0
        assert numbered.count() == 30000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_line_fails(spark, tmp_path):
    path = write_file(tmp_path / "bad.txt", [["x"] * 86])
    with pytest.raises(Exception):
        contracts.read_contracts(spark, path).collect()


def test_attach_needs_equal_lengths(spark, tmp_path):
    body = write_file(tmp_path / "body.txt", [contract_line(i, 85) for i in range(10)])
    target = write_file(tmp_path / "target.txt", [[i % 2] for i in range(9)])
    with pytest.raises(ValueError):
        contracts.attach_by_position(
            contracts.read_contracts(spark, body, with_target=False), contracts.read_targets(spark, target))


def test_ingest_keeps_ids_apart(spark, tmp_path):
    train = write_file(tmp_path / "train.txt", [contract_line(i) for i in range(50)])
    test = write_file(tmp_path / "test.txt", [contract_line(i, 85) for i in range(30)])
    target = write_file(tmp_path / "target.txt", [[i % 3 == 0] for i in range(30)])
    with open(target, "w") as out:
        out.writelines(f"{int(i % 3 == 0)}\n" for i in range(30))
    outs = [str(tmp_path / name) for name in ("train", "test")]
    summary = {r["dataset"]: r for r in ingest(spark, train, test, target, *outs).collect()}
    assert (summary["train"]["n_rows"], summary["test"]["n_rows"]) == (50, 30)
    assert summary["test"]["positive_rate"] == pytest.approx(1 / 3) and summary["test"]["n_columns"] == 15
    ids = read_policies(spark, outs[0]).unionByName(read_policies(spark, outs[1])).select("policy_id")
    assert ids.distinct().count() == 80
    assert ids.agg(F.max("policy_id")).first()[0] == "POL0000079"
    assert len(RAW_COLUMNS) == 86


def test_nan_is_read_as_null(spark, five_labelled, tmp_path):
    path = write_table(five_labelled.withColumn("annual_premium", F.lit(float("nan"))), str(tmp_path / "p"))
    assert read_policies(spark, path).where("annual_premium IS NULL").count() == 5


def test_state_roundtrip_and_fallback(spark, tmp_path):
    medians = spark.createDataFrame([("auto", 10.0)], "lob string, market_median double")
    path = state.save_market_state(medians, str(tmp_path / "state"))
    assert rows(state.load_market_state(spark, path)) == [("auto", 10.0)]
    assert state.load_market_state(spark, str(tmp_path / "none")).count() == 0


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = reports.append_run(spark, path, "a", {"depth": 3}, {"auc": 0.5})
    second = reports.append_run(spark, path, "b", {}, {"auc": 0.6})
    got = rows(reports.read_runs(spark, path), "run_id", "kind", "name", "value")
    assert len(got) == 3 and first != second and (second, "metric", "auc", "0.6") in got


def test_totals_are_written_once(spark):
    df = spark.range(100)
    assert rows(staging.settled(df)) == rows(df)


def test_shared_folder_is_the_session_setting(spark):
    class Conf:
        def __init__(self, **settings):
            self.settings = settings

        def get(self, key, default=None):
            return self.settings.get(key, default)

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, **settings):
            self.conf, self.sparkContext = Conf(**settings), Context(master)

    named = Session("yarn", **{"spark.checkpoint.dir": "s3a://shared/checkpoints"})
    assert staging.shared_folder(named) == "s3a://shared/checkpoints"
    with pytest.raises(RuntimeError):
        staging.shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert staging.shared_folder(local) == staging.shared_folder(local) == local.sparkContext.folder
    assert staging.shared_folder(spark) in staging.new_path(spark, "x")


def test_intermediate_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    assert staging.stage(spark.range(3), "x").count() == 3
    assert os.listdir(tmp_path / "policylens")
    staging.remove_intermediate(spark)
    assert not os.listdir(tmp_path / "policylens")


def test_jobs_leave_no_intermediate_tables(spark, tmp_path, monkeypatch):
    sides = [write_table(inputs.policies(spark, MEDIUM).where(inputs.client_no() % 2 == i), str(tmp_path / f"side{i}"))
             for i in (0, 1)]
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path / "shared"))
    report, aucs = drift_job(spark, *sides, str(tmp_path / "out"), scorer=inputs.scorecard, timestamp="now")
    own = next((tmp_path / "shared" / "policylens").iterdir())
    assert not list(own.iterdir())
    assert report.first()["n_reference"] + report.first()["n_current"] == inputs.policies(spark, MEDIUM).count()
    assert aucs.count() == 1
    with pytest.raises(ValueError), staging.scratch(spark) as outer:
        with staging.scratch(spark) as inner:
            assert inner.startswith(outer) and staging.stage(spark.range(2), "x").count() == 2
        assert not os.path.exists(inner)
        staging.stage(spark.range(2), "y")
        raise ValueError
    assert not list(own.iterdir())


def test_fitted_models_are_compared(spark, tmp_path, monkeypatch):
    parts = train_plan.split_ordered(inputs.policies(spark, MEDIUM))
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    monkeypatch.setattr(train_plan, "ALTERNATIVE", {"n_estimators": 3, "max_depth": 2})
    scores, compared = train_plan.compare_models(
        train, test, ["tenure_months", "claim_count_12m"], {"n_estimators": 4, "max_depth": 2}, str(tmp_path))
    found = {r["model"]: r for r in compared.collect()}
    assert set(found) == {"baseline", "boosted", "alternative"}
    frame = scores.toPandas()
    assert frame["policy_id"].value_counts().eq(3).all() and len(frame) == 3 * test.count()
    for name, mine in frame.groupby("model"):
        y, p = mine["churn_label"].to_numpy(), mine["churn_probability"].to_numpy()
        above = p[y == 1][:, None] - p[y == 0][None, :]
        assert found[name]["auc"] == pytest.approx(((above > 0) + 0.5 * (above == 0)).mean())
        assert found[name]["brier"] == pytest.approx(((p - y) ** 2).mean())


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("model"))
    space = {**md.SEARCH_SPACE, "n_estimators": (3, 6, "int"), "max_depth": (2, 3, "int")}
    return out, train_job(inputs.policies(spark, MEDIUM), out, n_trials=1, k=2, space=space)


def test_training_job(spark, trained):
    out, result = trained
    metrics = {(r["run_name"], r["metric"]): r["value"] for r in result.metrics.collect()}
    assert metrics["logistic_baseline", "auc_roc"] > 0.6 and metrics["boosted_search", "auc_roc"] > 0.6
    assert len(result.features) == 34 and result.importance.count() == 34
    assert result.lift.count() == 5
    assert {r["run_name"] for r in reports.read_runs(spark, f"{out}/runs").collect()} == {
        "logistic_baseline", "boosted_search"}


def test_training_options(spark, tmp_path):
    space = {**md.SEARCH_SPACE, "n_estimators": (2, 3, "int"), "max_depth": (2, 2, "int")}
    out = str(tmp_path / "model")
    policies = inputs.policies(spark, MEDIUM)
    train_job(policies, out, n_trials=1, k=1, space=space, fit_scope="all", calib_on="holdout")
    assert rows(state.load_market_state(spark, f"{out}/market_state")) == rows(inputs.market_state(spark, MEDIUM))


def test_search_is_repeatable_and_skips_folds_without_positives(spark):
    df = inputs.scores(spark, MEDIUM).select("policy_id", "tenure_months", "claim_count_12m", LABEL)
    early = inputs.client_no() < 700
    late_only = df.withColumn(LABEL, F.when(early, 0).otherwise(F.col(LABEL)))
    space = {**md.SEARCH_SPACE, "n_estimators": (2, 3, "int"), "max_depth": (2, 2, "int")}
    found = [md.search_boosted(late_only, ["tenure_months", "claim_count_12m"], n_trials=2, k=2, space=space)
             for _ in range(2)]
    assert found[0].params == found[1].params and found[0].cv_auc == pytest.approx(found[1].cv_auc)
    assert len(found[0].trials) == 2 and found[0].cv_auc > 0.5
    for name, (low, high, _) in space.items():
        assert all(low <= trial[name] <= high for trial in found[0].trials)


def test_calibration_meets_its_targets(spark, trained):
    parts = inputs.scores(spark, MEDIUM)
    names = ["tenure_months", "claim_count_12m", "premium_change_pct"]
    model = md.train_boosted(parts, names, {"n_estimators": 5, "max_depth": 2, "learning_rate": 0.1})
    negatives, positives = md.class_counts(parts)
    target = positives * (positives + 1) / (positives + 2) + negatives / (negatives + 2)
    for on in ("probability", "rawPrediction"):
        scored = md.positive_probability(md.calibrate(model, parts, on=on), parts.drop("churn_probability"), "calibrated")
        assert scored.agg(F.sum("churn_probability")).first()[0] == pytest.approx(target, rel=1e-3)


def test_batch_and_evaluation_jobs(spark, trained, tmp_path):
    out, _ = trained
    policies = inputs.policies(spark, MEDIUM)
    labelled = write_table(policies, str(tmp_path / "labelled"))
    requests = write_table(policies.drop(LABEL).withColumn("last_contact_days", F.lit(None).cast("int")),
                           str(tmp_path / "requests"))
    result = batch_score(spark, requests, str(tmp_path / "scores"), model_dir=out)
    assert result.count() == 1500 and result.where("churn_probability IS NULL OR risk_tier IS NULL").count() == 0
    gate = eval_job(spark, labelled, out, str(tmp_path / "report")).first()
    assert gate["min_auc"] == 0.7 and gate["passed"] == (gate["auc_roc"] >= 0.7)
    files = [f for f in os.listdir(tmp_path / "report") if f.endswith(".json")]
    assert len(files) == 1
    lines = [json.loads(line) for line in open(tmp_path / "report" / files[0])]
    assert {(line["section"], line["metric"]) for line in lines} >= {("overall", "auc_roc")}


def test_score_equals_its_own_pipeline(spark, trained):
    out, result = trained
    medians = state.load_market_state(spark, f"{out}/market_state")
    requests = inputs.requests(spark, MEDIUM)
    ours = scoring.score(requests, medians, result.model, "calibrated")
    stored = scoring.score(requests.repartition(7), medians, PipelineModel.load(f"{out}/model"), "calibrated")
    assert rows(ours, "policy_id", "churn_probability") == rows(stored, "policy_id", "churn_probability")


def test_stream_with_the_stored_model_equals_the_batch_job(spark, trained, tmp_path):
    out, _ = trained
    model, medians = PipelineModel.load(f"{out}/model"), state.load_market_state(spark, f"{out}/market_state")
    source, scores, summary, progress = (str(tmp_path / n) for n in ("in", "scores", "summary", "progress"))
    inputs.requests(spark, MEDIUM).repartition(3).write.parquet(source)
    score_stream(
        read_stream(spark, source), lambda batch: scoring.score(batch, medians, model, "calibrated"),
        scores, summary, progress).awaitTermination()
    batch = batch_score(spark, source, str(tmp_path / "batch"), model_dir=out)
    assert rows(spark.read.parquet(scores).drop("batch_id")) == rows(batch)


def test_stream_equals_batch_and_goes_on_where_it_stopped(spark, tmp_path):
    requests = inputs.requests(spark, MEDIUM)
    source, scores, summary, progress = (str(tmp_path / n) for n in ("in", "scores", "summary", "progress"))
    early = inputs.client_no() < 900

    def run():
        query = score_stream(read_stream(spark, source, 2), inputs.scorecard, scores, summary, progress)
        query.awaitTermination()

    requests.where(early).repartition(4).write.parquet(source)
    run()
    requests.where(~early).repartition(3).write.mode("append").parquet(source)
    run()
    streamed = spark.read.parquet(scores).drop("batch_id")
    assert rows(streamed) == rows(batch_result(inputs.scorecard(requests)))
    totals = spark.read.parquet(summary).agg(F.sum("total_at_risk"), F.sum("total_premium_at_risk")).first()
    whole = scoring.at_risk_summary(inputs.scorecard(requests).withColumn("pos", F.lit(0))).first()
    assert totals[0] == whole[0] and totals[1] == pytest.approx(whole[1])


def test_stream_takes_the_first_request_and_keeps_the_refused(spark, tmp_path):
    """An older small file and a newer larger one with the same id in one batch; one record is refused."""
    one = inputs.requests(spark, MEDIUM).limit(1).withColumn("claim_count_12m", F.lit(9)).withColumn("tenure_months", F.lit(6))
    source, scores, summary, progress = (str(tmp_path / n) for n in ("in", "scores", "summary", "progress"))
    one.withColumn("annual_premium", F.lit(100.0)).coalesce(1).write.parquet(source)
    time.sleep(1.1)
    later = one.withColumn("annual_premium", F.lit(900.0)).crossJoin(spark.range(3)).drop("id")
    refused = one.withColumn("insured_age", F.lit(5)).withColumn("policy_id", F.lit("young"))
    later.unionByName(refused).coalesce(1).write.mode("append").parquet(source)
    score_stream(read_stream(spark, source), inputs.scorecard, scores, summary, progress).awaitTermination()
    total = spark.read.parquet(summary).first()
    assert (total["total_at_risk"], total["total_premium_at_risk"]) == (4, 400.0)
    bad = spark.read.parquet(f"{scores}-rejected").collect()
    assert [(r["policy_id"], r["reasons"]) for r in bad] == [("young", ["insured_age"])]


def test_every_request_is_scored_whatever_is_missing(spark, trained, tmp_path):
    out, _ = trained
    holes = inputs.requests(spark, MEDIUM).limit(60)
    for i, column in enumerate(("annual_premium", "tenure_months", "insured_age", "claim_count_12m", "premium_change_pct")):
        holes = holes.withColumn(column, F.when(inputs.client_no() % 5 != i, F.col(column)))
    source = write_table(holes, str(tmp_path / "holes"))
    scored = batch_score(spark, source, str(tmp_path / "scored"), model_dir=out)
    assert scored.count() == 60 and scored.where("churn_probability IS NULL OR isnan(churn_probability)").count() == 0


def test_monitoring_job_writes_json(spark, tmp_path):
    df = inputs.policies(spark, MEDIUM)
    sides = [write_table(part, str(tmp_path / name)) for name, part in (
        ("old", df.where("tenure_months > 35")), ("new", df.where("tenure_months <= 35")))]
    report, compared = drift_job(spark, *sides, str(tmp_path / "out"), scorer=inputs.scorecard, timestamp="t")
    assert report.first()["alert"] and compared.count() == 1
    stored = spark.read.json(str(tmp_path / "out" / "drift")).first()
    assert stored["timestamp"] == "t" and stored["share_drifted_features"] == report.first()["share_drifted_features"]
    assert drift_job(spark, *sides, str(tmp_path / "again"))[1] is None


def test_portfolio_keeps_first_premiums_over_batches_and_restarts(spark, tmp_path):
    source, entries, progress = (str(tmp_path / n) for n in ("in", "entries", "progress"))
    policies = inputs.policies(spark, MEDIUM).drop(LABEL).where("policy_id < 'POL0000040'")

    def total():
        stream = read_stream(spark, f"{source}/*", files_per_batch=1)
        portfolio_stream(stream, lambda df: df.withColumn("churn_probability", F.lit(0.9)), entries, progress).awaitTermination()
        return tuple(portfolio_total(spark, entries).first())
    first = policies.agg(F.count(F.lit(1)), F.sum("annual_premium")).first()
    for number, factor in enumerate((1, 2, 5)):
        later = policies.withColumn("annual_premium", F.col("annual_premium") * factor)
        broken = later.limit(3).withColumn("insured_age", F.lit(3))
        later.unionByName(broken).coalesce(1).write.parquet(f"{source}/{number}")
        assert total() == (first[0] * (number + 1), pytest.approx(first[1] * (number + 1)))
    assert total() == (first[0] * 3, pytest.approx(first[1] * 3))  # nothing new has arrived


def test_lines_are_numbered_by_file_number_without_a_copy(spark, tmp_path):
    for number, lines in ((99999, 3), (100000, 400), (7, 0), (8, 2)):
        (tmp_path / f"part-{number}.csv").write_text("".join(f"{number}\t{i}\n" for i in range(lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")  # several blocks of one file, several files in one task
    try:
        scan = spark.read.schema("part int, line int").option("sep", "\t").csv(str(tmp_path))
        numbered = contracts.with_row_number(scan)
        assert "lines-" not in numbered._jdf.queryExecution().toString()
        got = [(r["part"], r["line"]) for r in sorted(numbered.collect(), key=lambda r: r["row_no"])]
        assert [r["row_no"] for r in numbered.orderBy("row_no").collect()] == list(range(405))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(8, 0), (8, 1)] + [(99999, i) for i in range(3)] + [(100000, i) for i in range(400)]
    with pytest.raises(Exception, match="not split as they were counted"):
        numbered.sparkSession.conf.set("spark.sql.files.maxPartitionBytes", "300")
        try:
            numbered.select("row_no").distinct().collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
