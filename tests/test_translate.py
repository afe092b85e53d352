import pytest
from pyspark.sql import functions as F

from policylens.functions.noise import HashedNoise, ModularNoise
from policylens.operators.translate import translate
from policylens.schema import POLICY, RAW_COLUMNS


@pytest.fixture(scope="module")
def raw(spark):
    base = {c: 0 for c in RAW_COLUMNS}
    cases = [
        {},
        {"PPERSAUT": 3, "PBRAND": 3},
        {"PBRAND": 2, "PWAPART": 2, "PLEVEN": 2},
        {"PLEVEN": 9, "PMOTSCO": 1, "PWERKT": 4, "MGEMLEEF": 9, "MKOOPKLA": 7},
        {"AWAPART": 8, "APERSAUT": 8, "MAANTHUI": 10, "MGEMLEEF": 6, "MKOOPKLA": 4, "CARAVAN": 1},
    ]
    rows = [tuple([i] + [{**base, **case}[c] for c in RAW_COLUMNS]) for i, case in enumerate(cases)]
    return spark.createDataFrame(rows, ["row_no", *RAW_COLUMNS])


def test_schema_and_values(raw):
    out = translate(raw, "row_no", noise=ModularNoise())
    assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in POLICY.fields]
    got = out.orderBy("policy_id").collect()
    assert [r["policy_id"] for r in got] == [f"POL{i:07d}" for i in range(5)]
    assert [r["lob"] for r in got] == ["auto", "auto", "home", "health", "auto"]
    assert [r["annual_premium"] for r in got] == [50.0, 600.0, 460.0, 860.0, 50.0]
    assert [r["policy_count_active"] for r in got] == [1, 2, 3, 2, 1]
    assert [r["insured_age"] for r in got] == [25, 25, 25, 75, 75]
    assert [r["channel"] for r in got] == ["Direct", "Direct", "Direct", "Agent", "Direct"]
    assert got[4]["claim_count_12m"] == 10 and got[4]["claim_settled_pct"] == 0.5
    assert got[4]["days_to_settle_avg"] == 75.0 and got[4]["churn_label"] == 1


def test_ids_never_truncate(spark, raw):
    far = translate(raw.where("row_no = 0"), "row_no", id_offset=123456789)
    assert far.first()["policy_id"] == "POL123456789"


def test_missing_columns_are_skipped(raw):
    out = translate(raw.drop("PMOTSCO", "CARAVAN", "PFIETS"), "row_no")
    assert "churn_label" not in out.columns and out.count() == 5


def test_noise_ranges_and_partition_independence(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    noise = HashedNoise(42)
    drawn = keys.select(
        "k", noise.tenure_jitter(F.col("k")).alias("t"), noise.contact_jitter(F.col("k")).alias("c"),
        noise.premium_change(F.col("k")).alias("p"))
    stats = drawn.agg(
        F.min("t"), F.max("t"), F.min("c"), F.max("c"), F.avg("p"), F.stddev("p"), F.countDistinct("t")).first()
    assert tuple(stats)[:4] == (0, 5, 10, 59) and stats[6] == 6
    assert stats[4] == pytest.approx(2.0, abs=0.15) and stats[5] == pytest.approx(5.0, abs=0.15)
    again = keys.repartition(17).select("k", noise.premium_change(F.col("k")).alias("q"))
    assert drawn.join(again, "k").where("p <> q").count() == 0
    other = keys.select("k", HashedNoise(43).premium_change(F.col("k")).alias("q"))
    assert drawn.join(other, "k").where("p <> q").count() > 15000
