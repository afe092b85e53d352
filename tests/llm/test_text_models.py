"""Fingerprints, language, toxicity, urls and decontamination on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import as_dict, documents, odd_texts, words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.llm import decontamination, language_id, order_minhash, toxicity, url_filter
from policylens.llm.rolling import Texts


def slow_sketch(text, sketches=32, k=5, picked=2):
    """Order MinHash by plain lists, with the hashes of the operator."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return [()] * sketches
    k = min(k, len(codes))
    grams = [text[i:i + k] for i in range(len(text) - k + 1)]
    kinds = order_minhash.OVER_FIRST.windows(
        order_minhash.OVER_FIRST.prefix(order_minhash.mix(codes.astype(np.uint64) + np.uint64(1))), k)
    seen, numbered = Counter(), []
    for place, (gram, kind) in enumerate(zip(grams, kinds.tolist())):
        with np.errstate(over="ignore"):
            mixed = order_minhash.mix(np.array([kind >> 20], np.uint64) + np.uint64(seen[gram]) * np.uint64(0x9E3779B97F4A7C15))
        numbered.append((int(mixed[0]) >> 20, place, gram))
        seen[gram] += 1
    out = []
    for s in range(sketches):
        mine = sorted(n for n in numbered if n[0] >> 39 == s)[:picked]
        out.append(tuple(g for _, g in sorted((p, g) for _, p, g in mine)))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 25, 2000])
def test_edited_texts_and_likeness(odd, empty, slice_bytes, monkeypatch):
    monkeypatch.setattr(order_minhash.neighbours, "__defaults__", ("doc_id", "text", slice_bytes))
    texts = odd_texts()
    result = as_dict(order_minhash.edit_report(odd))
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        own, other, third = (order_minhash.sketch(t) for t in (text, changed, following))
        r = result[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == own.astype(">u4").tobytes().hex()
        assert r["edited_fingerprint"] == other.astype(">u4").tobytes().hex()
        assert (r["near_edited"], r["near_next"]) == (order_minhash.likeness(own, other), order_minhash.likeness(own, third))
    assert result[0]["fingerprint"] == result[1]["fingerprint"]
    assert order_minhash.edit_report(empty).count() == 0


def test_sketch_selects_and_keeps_order():
    rng = random.Random(1)
    texts = [words(rng, 60), "abcab" * 30, "x", "", "aaaaaaa"]
    for a in texts:
        for b in [*texts, a[7:] + a[:7], a + a]:
            same = np.array([p == q for p, q in zip(slow_sketch(a), slow_sketch(b))])
            assert (same == (order_minhash.sketch(a) == order_minhash.sketch(b))).all()
    base = words(rng, 400, 4000)
    moved = base[len(base) // 2:] + base[:len(base) // 2]
    light = base.replace("w1", "v1", 3)
    near = order_minhash.likeness(order_minhash.sketch(base), order_minhash.sketch(light))
    far = order_minhash.likeness(order_minhash.sketch(base), order_minhash.sketch(words(rng, 400, 4000)))
    assert near > order_minhash.likeness(order_minhash.sketch(base), order_minhash.sketch(moved)) > far


def test_neighbours_of_odd_ids(spark, strange):
    rows = order_minhash.edit_report(strange).collect()
    assert len(rows) == strange.count()
    one = documents(spark, ["alone here"])
    assert order_minhash.edit_report(one).first()["near_next"] == 1.0
    assert order_minhash.fingerprints(strange.withColumn("fingerprint", F.lit(1))).count() == strange.count()


def test_a_hot_id_is_divided_and_no_two_ranges_share_a_task(spark):
    rng = random.Random(8)
    texts = [words(rng, 12) for _ in range(300)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i for i in range(300)]
    docs = documents(spark, texts, ids=ids)
    keyed = docs.select(
        F.bitwise_not(F.coalesce("doc_id", F.lit(order_minhash.NO_ID))).alias("back"), F.xxhash64("text").alias("hash"), "text")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(order_minhash, "SAMPLE_PER_CUT", 300)  # every row
        sliced, follows, n = order_minhash._slices(keyed, 3000)
        assert n == len(follows) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 2
        dealt = sliced.repartitionById(n, F.col("slice")).withColumn("task", F.spark_partition_id())
        sizes = {(r["slice"], r["task"]): r["count"] for r in dealt.groupBy("slice", "task").count().collect()}
        assert {a for a, _ in sizes} == {b for _, b in sizes} == set(range(n)) and max(sizes.values()) <= 300 // n + 1
        patch.setattr(order_minhash.neighbours, "__defaults__", ("doc_id", "text", 3000))
        got = order_minhash.neighbours(docs, lambda i, a, b: (i, a, b), T.StructType.fromDDL("id long, own string, next string")).collect()
    place = {r["text"]: (r["back"], r["hash"]) for r in keyed.collect()}
    order = sorted(texts, key=place.get)
    assert {r["own"]: r["next"] for r in got} == {t: order[(i + 1) % 300] for i, t in enumerate(order)} and len(got) == 300


def test_rules_and_parts(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f", "https://example.net/de/", "http://notexample.net/en/", "example.net/en/", None, "",
        "http://x.example.com/de/1", "http://x.example.com/de", "http://w.org/fr/", "http://worg/fr/", "a://b://c.net/en/",
        "http://net/", "http://net", "http:///only/path", "http://example.net?/en/", "ftp://Ü.net/ß#x", "http://k.org/en/" + "z" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn(
        "features", F.lit(1))
    model = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    result = as_dict(url_filter.judge_urls(pages, model), "page_id")
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host):])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fitting = [r for r in url_filter.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0]))
                   and path.startswith("/" + r[0].split("/", 1)[1])]
        name, verdict = max(fitting, key=lambda r: len(r[0]), default=(None, None))
        r = result[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (verdict or ("block" if r["blocked_by_model"] else "allow"))
    assert url_filter.judge_urls(pages.limit(0), model).count() == 0


def test_url_model_learns_its_table_and_more(spark):
    model = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    unseen = [("http://www.ads-track.example.org/fr/99", True), ("https://spam-farm.example.com/x", True),
              ("https://thon.example.com/en/17.html", False), ("https://blog.therth.example.org/de/5", False)]
    rows = [(i, u) for i, (u, _) in enumerate([*unseen, *url_filter.LABELLED])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    result = as_dict(url_filter.judge_urls(pages, model), "page_id")
    wanted = [b for _, b in unseen] + [bool(y) for _, y in url_filter.LABELLED]
    assert [result[i]["blocked_by_model"] for i in range(len(rows))] == wanted
    plan = url_filter.judge_urls(pages, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_probability_is_that_of_the_weights(spark):
    """Brute force: the model's margin is the sum of the weights of the hashed n-grams."""
    model = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    row = url_filter.with_features(url_filter.with_parts(
        spark.createDataFrame([("http://ads.example.org/a",)], "url string"))).select("features").first()
    host, path = "^ads.example.org$", "^/a$"
    grams = {f"{m}{n}:{t[i:i + n]}" for m, t in (("h", host), ("p", path)) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    assert len(row["features"].indices) <= len(grams) and set(row["features"].values) == {1.0}
    assert len(row["features"].indices) > len(grams) - 4
    margin = model.intercept + sum(model.coefficients[int(i)] for i in row["features"].indices)
    assert (margin > 0) == bool(model.predict(row["features"]))


LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "opqrstuv"}


def speech(rng, lang, n=40):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language_is_learnt(spark):
    rng = random.Random(0)
    rows = [(i, speech(rng, lang), lang) for i in range(240) for lang in [list(LETTERS)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit_language_model(df.where("doc_id < 120"), rows=90)
    assert model[0] == ["aa", "bb", "cc"]
    more = spark.createDataFrame(
        [(1000, None, None), (1001, "", None), (1002, "12 34 !?", None), (1003, "  \n", None)], df.schema)
    result = as_dict(language_id.predict_language(df.unionByName(more).withColumn("score", F.lit("x")), model))
    assert sum(result[i]["lang_pred"] == lang for i, _, lang in rows if i >= 120) >= 118
    assert all(result[i]["lang_pred"] == "und" and result[i]["score"] == 0 for i in range(1000, 1004))
    assert all(0 <= r["score"] <= 1 for r in result.values())
    assert language_id.predict_language(df.limit(0), model).count() == 0
    assert language_id.fit_language_model(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict_language(df, None).collect()} == {"und"}


def test_landmark_products_equal_the_kernel(spark):
    """Brute force of the scores: kernels with the landmarks, one at a time."""
    rng = random.Random(1)
    texts = [speech(rng, list(LETTERS)[i % 3]) for i in range(30)]
    languages = [list(LETTERS)[i % 3] for i in range(30)]
    presence = language_id.gram_rows(texts)
    classes, matrix, level = language_id.fit_kernel_ridge(presence, languages, landmarks=30)
    sets = [{t.lower()[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    x = language_id.normalised(presence)
    assert np.abs(x @ x.T - kernel).max() < 0.05  # hashing may join some n-grams
    k = (x @ x.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + language_id.SMOOTH * max(1.0, values.max()))) @ vectors.T
    phi = k @ root
    y = (np.array(languages)[:, None] == np.array(classes)).astype(float)
    centred = phi - phi.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + language_id.RIDGE * np.eye(30), centred.T @ (y - y.mean(axis=0)))
    expected = centred @ w + y.mean(axis=0)
    assert np.abs(x @ matrix + level - expected).max() < 1e-3
    long = speech(rng, "aa", 70_000)
    whole = {long.lower()[i:i + n] for n in (1, 2, 3) for i in range(len(long) - n + 1)}
    assert abs(int(language_id.gram_rows([long])[0].sum()) - len(whole)) < 0.05 * len(whole)


def test_held_out_is_by_crc(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"),
                                language_id.held_out("id").alias("held"))
    assert {r["doc_id"]: r["held"] for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def labelled_texts(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        text = words(rng, 40, 300).split()
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["vilest,", "Rotten", "foulness"])
        text = ["zz!!"] * 20 + text if low else text
        rows.append((i, " ".join(text), int(low), int(toxic)))
    return rows


def test_toxicity_chain(spark, odd, empty):
    schema = "doc_id long, text string, low_quality int, toxic int"
    rows = labelled_texts()
    df = spark.createDataFrame(rows, schema)
    model = toxicity.fit_toxicity(df.where("doc_id < 250"))
    result = as_dict(toxicity.score_toxicity(df, model))
    held = [r for r in rows if r[0] >= 250]
    assert sum((result[i]["p_toxic"] > 0.5) == bool(t) for i, _, _, t in held) >= 0.97 * len(held)
    assert sum((result[i]["p_low_quality"] > 0.5) == bool(q) for i, _, q, _ in held) >= 0.97 * len(held)
    kept = {r["doc_id"] for r in toxicity.keep_clean(df, model).collect()}
    assert kept == {i for i, r in result.items() if r["p_toxic"] < toxicity.REJECT}
    blank = {i for i, t in enumerate(odd_texts()) if not (t or "").split()}
    scored = as_dict(toxicity.score_toxicity(odd, model))
    assert all(scored[i]["p_toxic"] == 0 for i in blank) and len(scored) == len(odd_texts())
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity(df.limit(0)) is None
    assert toxicity.keep_clean(df, None).count() == len(rows)


def test_only_usable_labels_take_places_in_the_sample(spark):
    texts = [None, "", " \t\n ", "\x0b\r"] * 15 + [f"some words {i}" for i in range(40)]
    labels = [(i, 1, 0) for i in range(300)] + [(None, 0, 1)]  # from 100 on without a document
    labels = [(i, None if i and 60 <= i < 70 else q, None if i and 70 <= i < 80 else t) for i, q, t in labels]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    taken = toxicity.labelled_documents(documents(spark, texts), table, rows=20).collect()
    assert len(taken) == 20 and {r["text"] for r in taken} <= set(texts[80:])


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    first = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    second = np.where(rng.random(400) < 0.9, first, 1 - first)
    folds = np.arange(400) % 4
    models = toxicity.fit_chain(x, np.stack([first, second], axis=1), folds)
    assert len(models[0][0]) == 5 and len(models[1][0]) == 6 and models[1][0][-1] > 0
    # Brute force of the second model's input.
    out = np.empty(400)
    for fold in range(4):
        inside = folds == fold
        out[inside] = toxicity.probability(x[inside], toxicity.fit_logistic(x[~inside], first[~inside]))
    again = toxicity.fit_logistic(np.hstack([x, out[:, None]]), second)
    assert np.allclose(again[0], models[1][0]) and np.isclose(again[1], models[1][1])
    chained = toxicity.run_chain(x, models)
    p = toxicity.probability(x, models[0])
    assert np.allclose(chained[:, 1], toxicity.probability(np.hstack([x, p[:, None]]), models[1]))
    # The penalised gradient is zero at the fitted weights.
    mean, scale = x.mean(axis=0), x.std(axis=0)
    gradient = ((x - mean) / scale).T @ (first - p) - 10 * toxicity.PENALTY * models[0][0] * scale
    assert np.abs(gradient).max() < 0.5
    # Beyond what was seen nothing changes any more.
    assert np.allclose(toxicity.probability(x * 50, models[0]), toxicity.probability(np.clip(x * 50, x.min(axis=0), x.max(axis=0)), models[0]))
    alike = toxicity.fit_logistic(x, np.zeros(400))
    assert toxicity.probability(x, alike).max() < 1e-6


def slow_passages(texts, items, similarity=0.8):
    found = {}
    for i, text in enumerate(texts):
        w = (text or "").encode().lower().split()
        for item, passage in items:
            q = (passage or "").encode().lower().split()
            span, width = min(len(q), len(w)), min(5, len(q))
            if not span:
                continue
            counts = decontamination.shingles(q, width)
            for s in range(len(w) - span + 1):
                alike = decontamination.weighted_similarity(counts, decontamination.shingles(w[s:s + span], width))
                if alike >= similarity and alike > found.get((i, item), (0, 0, 0))[2]:
                    found[i, item] = (s, span, alike)
    return found


def test_passages_are_found(spark, odd, empty, strange):
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate((14, 30, 30, 45, 59, 3, 1, 5))] + [(50, None), (51, " "), (None, "x y z")]
    plain = [words(rng, 200) for _ in range(6)]
    changed = items[3][1].split()
    changed[1] = "other"
    texts = [
        plain[0] + " " + items[1][1] + " " + plain[1], items[2][1].upper(), plain[2] + "\n" + " ".join(changed) + "\n" + plain[3],
        items[4][1][:-8], " ".join(items[4][1].split()[:40]), plain[4], None, "", items[1][1] + " " + items[1][1] + " " + items[5][1],
        items[6][1], items[7][1] + " " + plain[5]]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, extra=True)
    result = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["similarity"])
              for r in decontamination.find_passages(docs, table).collect()}
    expected = slow_passages(texts, [i for i in items if i[0] is not None])
    assert result == expected and len(expected) >= 7
    kept = decontamination.keep_clean(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in expected}
    nothing = table.limit(0)
    assert decontamination.find_passages(docs, nothing).count() == 0
    assert decontamination.keep_clean(docs, nothing).count() == len(texts)
    assert decontamination.find_passages(empty, table).count() == 0
    assert decontamination.keep_clean(strange, nothing).count() == strange.count()


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, 20)) for i in range(30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [words(rng, 50) + " " + items[i][1] for i in range(0, 30, 3)])
    whole = {tuple(r) for r in decontamination.find_passages(docs, table).collect()}
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", ("item_id", "text", 900))
    assert {tuple(r) for r in decontamination.find_passages(docs, table).collect()} == whole
    assert len(whole) == 10


def test_blocks_find_everything_within_the_radius():
    rng = np.random.default_rng(3)
    index = decontamination.Index([(i, words(random.Random(i), 30)) for i in range(40)])
    prints = index.prints[rng.integers(0, 40, 500)]
    for _ in range(18):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    rows = np.arange(40)
    found = {(int(a), int(b)) for a, b, _ in zip(*index.within(prints, rows))}
    expected = {(i, j) for i in range(500) for j in range(40) if bin(int(prints[i] ^ index.prints[j])).count("1") <= 20}
    assert found == expected and expected


def test_items_that_repeat_a_shingle_are_found_at_any_distance():
    rng = random.Random(12)
    items = [(i, words(rng, 196, 5_000) + " blank" * (24 - i % 4)) for i in range(8)]
    items += [(8, words(rng, 30) + " _" * 40), (9, "0 " * 60), (10, "a b " * 50)]
    texts = [words(rng, 50, 5_000) + " " + t.rsplit(" blank", 20)[0] + " " + words(rng, 80, 5_000) for _, t in items[:8]]
    texts += [words(rng, 20) + " " + items[8][1][:-20] + " " + words(rng, 20), "0 " * 55 + words(rng, 30), "x " + "a b " * 70]
    index = decontamination.Index(items)
    found = {(t, items[row][0]): (start, n, alike)
             for t, row, start, n, bits, alike in index.search(Texts(pa.array(texts), lower=True))}
    assert found == slow_passages(texts, items) and len(found) >= 10
    far = [bits for *_, bits, _ in index.search(Texts(pa.array(texts), lower=True))]
    assert max(far) > decontamination.RADIUS
