"""The pipeline and the registered queries on small tables, stage by stage beside brute force."""

import os
import random
import sys

import corpus_pipeline
import pytest
from helpers import SCHEMA, as_dict, words
from policylens.llm import toxicity
from policylens.llm.queries import QUERIES, STATEMENTS
from test_dedup import slow_components, slow_print, slow_substrings
from test_text_models import labelled_texts, slow_passages
from test_tokens import check_packing

import __spark_entry__ as entry_module

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled documents with toxic ones, and behind them copies, near copies, shared passages and benchmark items."""
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("corpus"))
    labelled = labelled_texts(240, seed=4)
    texts = [t for _, t, _, _ in labelled]
    base, passage = words(rng, 260, 900), words(rng, 70, 900)
    near = base.split()
    near[40] = "other"
    items = [(i, words(rng, 30, 900)) for i in range(5)]
    texts += [
        base, base, " ".join(near), words(rng, 80, 900) + " " + passage, passage + "\n" + words(rng, 80, 900), None, "", " ",
        words(rng, 60, 900) + " " + items[2][1] + " " + words(rng, 60, 900), items[4][1].replace('w', 'W'), "short one", words(rng, 9000, 900)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(
        [(i, 1 - low, toxic) for i, _, low, toxic in labelled], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, labelled, items


def test_stages_beside_brute_force(spark, folder, tmp_path):
    path, labelled, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = as_dict(docs) if "doc_id" in docs.columns else {}, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns

    before, after = kept["toxicity"]
    ids = set(as_dict(after))
    toxic = {i for i, _, _, t in labelled if t}
    assert len(toxic - ids) >= 0.95 * len(toxic) and len(ids - toxic) >= 0.97 * (len(before) - len(toxic))

    before, after = kept["near_duplicates"]
    order = sorted(before)
    component = slow_components([slow_print(before[i]["text"]) for i in order], order)
    assert set(as_dict(after)) == set(component)

    before, after = kept["substring_dedup"]
    order = sorted(before)
    result = as_dict(after)
    expected = slow_substrings([before[i]["text"] for i in order])
    assert set(result) == set(order) and sum(gone for _, gone, _ in expected.values()) > 60
    for k, i in enumerate(order):
        _, gone, text = expected[k]
        assert result[i]["text"] == (text if gone else before[i]["text"])

    before, after = kept["decontamination"]
    order = sorted(before)
    hit = {order[k] for k, _ in slow_passages([before[i]["text"] for i in order], items)}
    assert set(as_dict(after)) == set(order) - hit and len(hit) == 2

    before, after = kept["packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(before)
    check_packing(rows, 2048)

    columns = sorted(after.columns)
    whole = corpus_pipeline.run(spark, path).select(*[c for c in columns if c not in ("sequence_id", "offset")])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.select(*whole.columns).collect()))


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    assert toxicity.REJECT == 0.4


def test_queries_are_registered():
    found = entry_module.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert set(STATEMENTS) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, name):
    _, count, problems = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], STATEMENTS[name])
    assert not problems and count > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATEMENTS)))
def test_query_returns_every_row(spark, name):
    df = QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()
    rows = df.count()
    assert rows == n if name not in ("op4_best_fit_packing", "op10_decontamination") else rows > 0
