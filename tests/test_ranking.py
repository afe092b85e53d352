import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policylens.operators import ranking as rk
from policylens.sources.staging import stage

ORDER = [("p", "desc"), "id"]


@pytest.fixture(scope="module", autouse=True)
def several_slices(spark):
    """Without this the small tables would be merged into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rk, "SLICE_ROWS", 1000)
        yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows, a third of them with one score, the rest in few or many others."""
    k = F.col("id")
    score = F.when(k % 3 == 0, F.lit(0.5)).when(k % 3 == 1, (k % 7) / 10.0).otherwise((k * 7919 % 10007) / 10007.0)
    return spark.range(30000).select(
        F.format_string("R%06d", (k * 48271) % 30011).alias("id"), score.alias("p"),
        F.when(k % 2 == 0, "hot").otherwise(F.format_string("g%d", k % 5)).alias("g"),
        (k % 4 == 0).cast("int").alias("y")).repartition(11)


def by_window(df):
    order = Window.orderBy(F.col("p").desc_nulls_last(), F.col("id").asc_nulls_last())
    return df.select("id", F.row_number().over(order).alias("rn"))


def test_global_rank_equals_one_window(skewed):
    ranked = rk.global_rank(skewed, ORDER).select("id", F.col("rn").alias("ours"))
    assert ranked.join(by_window(skewed), "id").where("ours <> rn").count() == 0
    assert ranked.agg(F.countDistinct("ours")).first()[0] == 30000


def test_slices_split_the_hot_score(skewed):
    laid = skewed.repartitionByRange(*rk.sort_columns(rk.parse_order(ORDER))).withColumn("s", F.spark_partition_id())
    sizes = [r["n"] for r in laid.groupBy("s").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 10000


def test_rank_does_not_depend_on_partitioning(skewed):
    first = rk.global_rank(skewed.repartition(1), ORDER).select("id", "rn")
    second = rk.global_rank(skewed.repartition(17), ORDER).select("id", F.col("rn").alias("other"))
    assert first.join(second, "id").where("rn <> other").count() == 0


def test_hot_group_is_spread_over_slices(skewed):
    sums = rk.prefix_sums(skewed, ORDER, {"upto": "y"}, by=["g"])
    expected = skewed.select("id", F.sum("y").over(
        Window.partitionBy("g").orderBy(F.desc("p"), "id").rowsBetween(Window.unboundedPreceding, 0)).alias("want"))
    assert sums.join(expected, "id").where("upto <> want").count() == 0


def test_running_sum_shuffles_rows_once(skewed, monkeypatch):
    """The plan that is written has one exchange, and no slice holds a third of the rows."""
    written = []
    monkeypatch.setattr(rk, "stage", lambda df, label: written.append(df) or stage(df, label))
    out = rk.prefix_sums(skewed.repartition(5).cache(), ORDER, {"upto": "y"}, by=["g"])
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange") == 1 and "shufflepartitionidpassthrough" in plan
    assert out.count() == 30000
    sizes = [r["count"] for r in written[0].groupBy("_slice").count().collect()]
    assert len(sizes) >= 4 and sum(sizes) == 30000 and max(sizes) < 10000


def test_running_sum_with_missing_and_equal_keys(spark):
    """Rows of one key share a slice, missing keys come last, and an empty table has no sums."""
    df = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("v"),
        F.when(F.col("id") % 2 == 0, "a").alias("g"), F.lit(1).alias("one"))
    last = rk.prefix_sums(df, ["v"], {"upto": "one"}, by=["g"], totals={"n": "upto"}).groupBy("g", "v").agg(
        F.max("upto").alias("last"), F.max("n").alias("n"))
    got = {(r["g"], r["v"]): (r["last"], r["n"]) for r in last.collect()}
    assert got == {(g, v): (800 * (v + 1) if v is not None else 6000, 6000) for g in ("a", None) for v in (0, 1, 2, 3, 4, None)}
    assert rk.prefix_sums(df.limit(0), ["v"], {"upto": "one"}).collect() == []


def test_prefix_totals(skewed):
    sums = rk.prefix_sums(skewed, ORDER, {"upto": "y"}, by=["g"], totals={"whole": "upto"})
    want = {r["g"]: r["w"] for r in skewed.groupBy("g").agg(F.sum("y").alias("w")).collect()}
    got = {(r["g"], r["whole"]) for r in sums.select("g", "whole").distinct().collect()}
    assert got == set(want.items())


@pytest.mark.parametrize("settle", [1, 50, 10**9])
def test_selection_equals_sorting(skewed, settle):
    ranks = [1, 2, 999, 10000, 15000, 20001, 29999, 30000]
    found = rk.keys_at_ranks(skewed, ORDER, [*ranks, 0, 30001], settle_rows=settle)
    want = {r["rn"]: r["id"] for r in by_window(skewed).where(F.col("rn").isin(ranks)).collect()}
    assert {rank: position.key[1] for rank, position in found.items()} == want
    assert all(position.rows_before == rank - 1 and position.rows_at == 1 for rank, position in found.items())


@pytest.mark.parametrize("settle", [20, 300])
def test_hot_score_is_narrowed_by_the_next_key(skewed, settle):
    order = rk.parse_order(ORDER)
    start = [rk._Bracket(None, None, 0, 30000, [10, 15000, 20000])]
    brackets = rk._narrow_down(skewed.select("p", "id"), order, start, settle)
    assert len(brackets) == 3 and all(b.rows <= settle for b in brackets)
    for b in brackets:
        inside = skewed.where(b.holds(order)).count()
        assert inside == b.rows and b.start < b.ranks[0] <= b.start + b.rows


def test_cuts_divide_a_heavy_value_and_stop_at_the_end():
    drawn = [((0.9, "a"), 1), *[((0.5, f"k{i:03d}"), 1) for i in range(200)], ((0.1, "z"), 1)]
    cuts = rk._choose_cuts(drawn, rk._Bracket(None, None, 0, 10**6, [1]))
    assert cuts[0] == (0.9,) and (0.5,) in cuts and sum(len(c) == 2 for c in cuts) > 30
    assert cuts == sorted(cuts, key=lambda c: (-c[0], c[1] if len(c) > 1 else "~"))
    inside = rk._choose_cuts(drawn[1:-1], rk._Bracket(None, (0.5, "k199"), 0, 10**6, [1]))
    assert (0.5,) not in inside and (0.5, "k199") not in inside and len(inside) > 30
    assert rk._choose_cuts([((1.0, "a"), 9)], rk._Bracket(None, (1.0, "a"), 0, 9, [1])) == []


def test_selection_with_many_equal_keys(spark):
    df = spark.range(10000).select((F.col("id") % 3).alias("v"))
    found = rk.keys_at_ranks(df, ["v"], [1, 3334, 3335, 10000], settle_rows=10)
    assert {r: (p.key, p.rows_before, p.rows_at) for r, p in found.items()} == {
        1: ((0,), 0, 3334), 3334: ((0,), 0, 3334), 3335: ((1,), 3334, 3333), 10000: ((2,), 6667, 3333)}


def test_missing_keys_come_last(spark):
    df = spark.createDataFrame([(None, "a"), (2.0, "b"), (1.0, None), (1.0, "c")], "p double, id string")
    ranked = {(r["p"], r["id"]): r["rn"] for r in rk.global_rank(df, ["p", "id"]).collect()}
    assert ranked == {(1.0, "c"): 1, (1.0, None): 2, (2.0, "b"): 3, (None, "a"): 4}


def test_quantiles_equal_numpy(spark, skewed):
    got = {r["g"]: [r[f"q{i}"] for i in range(4)] for r in
           rk.grouped_quantiles(skewed, ["g"], "p", [0.0, 0.25, 0.5, 0.99]).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part["p"], [0.0, 0.25, 0.5, 0.99])))


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 4.0), ("b", None), ("c", 7.0)], "g string, v double")
    got = {r["g"]: r["q0"] for r in rk.grouped_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {"a": 2.5, "b": None, "c": 7.0}


def test_split_follows_the_order(skewed):
    out = rk.split_ordered(skewed, ["id"])
    sizes = {r["part"]: (r["n"], r["lo"], r["hi"]) for r in out.groupBy("part").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert sizes["train"][0] == 24000 and sizes["test"][0] == 6000
    assert sizes["train"][2] < sizes["test"][1]


def test_split_refuses_a_tied_border(skewed):
    with pytest.raises(ValueError):
        rk.split_ordered(skewed, ["p"], 0.5)


def test_folds_expand(spark):
    df = spark.range(1500).select(F.format_string("P%05d", "id").alias("policy_id"))
    sizes = {(r["fold"], r["role"]): r["n"] for r in
             rk.time_folds(df).groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert [sizes[(f, "train")] for f in range(1, 6)] == [250, 500, 750, 1000, 1250]
    assert all(sizes[(f, "test")] == 250 for f in range(1, 6))
    folds = rk.time_folds(df.limit(17)).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("policy_id"))).alias("last"),
        F.min(F.when(F.col("role") == "test", F.col("policy_id"))).alias("next")).collect()
    assert all(r["last"] < r["next"] for r in folds)
    with pytest.raises(ValueError):
        rk.time_folds(df.limit(4))


def test_missing_keys_are_divided_by_the_next(spark):
    """A stretch of missing scores is narrowed by the ids instead of being ranked in one task."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 5 == 0, F.col("id") * 0.5).alias("score"), (F.col("id") * 7919 % 20_011).alias("key"))
    found = rk.keys_at_ranks(df, [("score", "desc"), "key"], [1, 4000, 4001, 12_345, 20_000], settle_rows=300)
    expected = sorted(df.collect(), key=lambda r: (r["score"] is None, -(r["score"] or 0), r["key"]))
    for rank, position in found.items():
        assert position.key == tuple(expected[rank - 1]) and position.rows_before == rank - 1
    assert len(found) == 5
    order = rk.parse_order([("score", "desc"), "key"])
    brackets = rk._narrow_down(df, order, [rk._Bracket(None, None, 0, 20_000, [12_345])], 300)
    assert all(b.rows <= 300 for b in brackets)


def test_border_among_missing_keys(spark):
    df = spark.range(1000).select(F.format_string("P%04d", "id").alias("policy_id"), F.when(F.col("id") % 5 > 1, F.col("id")).alias("v"))
    parts = rk.split_ordered(df, ["v", "policy_id"], 0.8)
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 800, "test": 200}
    assert parts.where("part = 'test' AND v IS NOT NULL").count() == 0


def test_ids_are_ordered_by_their_number(spark):
    df = spark.range(9_999_000, 10_001_000).select(F.format_string("POL%07d", "id").alias("policy_id"), "id")
    parts = rk.split_ordered(df, train_share=0.5).groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    assert {r["part"]: (r["low"], r["high"]) for r in parts.collect()} == {
        "train": (9_999_000, 9_999_999), "test": (10_000_000, 10_000_999)}
    folds = rk.time_folds(df.withColumn("n", F.col("id")), k=3).where("fold = 2")
    assert folds.where("role = 'train'").agg(F.max("n")).first()[0] < folds.where("role = 'test'").agg(F.min("n")).first()[0]
