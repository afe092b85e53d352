"""Toxicity by a chain of linear classifiers.

Method: the categories are predicted one after the other, and each model sees, beside the text's features, the probabilities
of the categories before it. Those inputs are out-of-fold when a model is trained: each sample row's earlier probabilities
come from models that did not see its fold, and copies of a text share a fold. At prediction the final models are chained.

Features: log(1 + count) of the words that hold a selected mark, a whole word or its first 4 to 8 letters, and seven numbers on
the shape of the text. Marks are selected for each category from the sample by the chi-square of presence. The sample is
bounded: the `rows` labelled texts that are first by a hash of the text, one of each different text. Words are lower-cased
and stripped of marks around them. Whole texts are read. Null and blank texts have probability 0 in every category and are
never rejected; a category whose labels are all alike gets its share as a constant.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm.chunks import small_batches, without
from policylens.sources.staging import stage

CATEGORIES = ("low_quality", "toxic")
ROWS, MARKS, FEWEST, FOLDS, PENALTY, STEPS, KEEP = 12_000, 256, 4, 4, 1.0, 12, 100_000
PREFIXES = range(4, 9)
AROUND = re.compile(r"^[\W_]+|[\W_]+$")
SHAPE, REJECT = 7, 0.4


def marks_of(word):
    """The marks of a raw word in bytes."""
    bare = AROUND.sub("", word.decode("utf-8").lower())
    return [f"={bare}", *[f"{n}{bare[:n]}" for n in PREFIXES if len(bare) >= n]] if bare else []


class Marks(dict):
    """Numbers of the selected marks of raw words, worked out once per worker."""

    def __init__(self, selected):
        super().__init__()
        self.number = {m: i for i, m in enumerate(selected)}

    def __missing__(self, word):
        if len(self) > KEEP:
            self.clear()
        found = self[word] = tuple(self.number[m] for m in marks_of(word) if m in self.number)
        return found


def shape(text, words):
    """Numbers that do not depend on the words' meaning."""
    data, n = text.encode("utf-8"), len(words)
    codes = np.frombuffer(data, np.uint8)
    upper = np.count_nonzero((codes >= 65) & (codes <= 90))
    other = np.count_nonzero((codes > 32) & (codes < 128) & ~(((codes | 32) >= 97) & ((codes | 32) <= 122)))
    distinct = len(set(words))
    return (math.log1p(n), distinct / n, upper / len(codes), other / len(codes), len(codes) / n / 10,
            math.log1p(n - distinct), float(sum(a == b for a, b in zip(words, words[1:])) / n))


def feature_rows(texts, marks):
    """(features of each text, which texts are blank)."""
    size = len(marks.number)
    out = np.zeros((len(texts), size + SHAPE), dtype=np.float32)
    blank = np.zeros(len(texts), dtype=bool)
    for row, text in enumerate(texts):
        words = (text or "").encode("utf-8").split()
        if not words:
            blank[row] = True
            continue
        found = [i for word in words for i in marks[word]]
        if found:
            out[row, :size] = np.log1p(np.bincount(found, minlength=size))
        out[row, size:] = shape(text, words)
    return out, blank


def fit_logistic(x, y, penalty=PENALTY, steps=STEPS):
    """(weights, intercept, least, largest) by Newton steps on standardised features with a ridge penalty.

    The last two are the range of each feature, beyond which the model does not extrapolate.
    """
    least, largest = x.min(axis=0), x.max(axis=0)
    if not 0 < y.mean() < 1:
        return np.zeros(x.shape[1]), -20.0 if y.mean() < 0.5 else 20.0, least, largest
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w = np.zeros(z.shape[1])
    w[-1] = math.log(y.mean() / (1 - y.mean()))
    ridge = np.full(z.shape[1], penalty * 10)
    ridge[-1] = 0

    def loss(w):
        m = z @ w
        return float(np.sum(np.logaddexp(0, m) - y * m) + 0.5 * np.sum(ridge * w * w))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6).astype(np.float32)
        step = np.linalg.solve(
            (z.T @ (z * curve[:, None])).astype(np.float64) + np.diag(ridge + 1e-6),
            (z.T @ (y - p)).astype(np.float64) - ridge * w)
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w, before, now = w + size * step, now, loss(w + size * step)
        if before - now < 1e-4 * max(1.0, now):
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - mean @ weights), least, largest


def probability(x, model):
    weights, intercept, least, largest = model
    return 1 / (1 + np.exp(-np.clip(np.clip(x, least, largest) @ weights + intercept, -30, 30)))


def fit_chain(x, labels, folds, n_folds=FOLDS):
    """One model per category in order. `labels`: one column of 0/1 per category; `folds`: a number for each row."""
    models, earlier = [], np.zeros((len(x), 0))
    for y in labels.T:
        seen = np.hstack([x, earlier])
        out = np.empty(len(x))
        for fold in range(n_folds):
            inside = folds == fold
            if inside.any():  # a sample of one fold has nothing else to learn from
                outside = ~inside if not inside.all() else inside
                out[inside] = probability(seen[inside], fit_logistic(seen[outside], y[outside]))
        models.append(fit_logistic(seen, y))
        earlier = np.hstack([earlier, out[:, None]])
    return models


def run_chain(x, models):
    """Probabilities of the categories, one column each."""
    earlier = np.zeros((len(x), 0))
    for model in models:
        earlier = np.hstack([earlier, probability(np.hstack([x, earlier]), model)[:, None]])
    return earlier


def select_marks(sample, categories, marks=MARKS, fewest=FEWEST):
    """For each category the marks whose presence tells most about it, by chi-square over the sample."""
    def present(batches):
        for batch in batches:
            rows, columns = [], [batch.column(i + 1).to_pylist() for i in range(len(categories))]
            for i, text in enumerate(batch.column(0).to_pylist()):
                found = {m for word in set(text.encode("utf-8").split()) for m in marks_of(word)}
                rows += [(m, *(c[i] for c in columns)) for m in found]
            made = list(zip(*rows)) if rows else [()] * (1 + len(categories))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[0], pa.string()), *[pa.array(m, pa.int32()) for m in made[1:]]], names=["mark", *categories])

    schema = ", ".join(["mark string", *[f"`{c}` int" for c in categories]])
    counts = sample.select("text", *categories).mapInArrow(present, schema).groupBy("mark").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= fewest)
    totals = sample.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    chosen = []
    for category, positive in zip(categories, totals[1:]):
        expected = F.col("n") * float(positive or 0) / float(totals[0] or 1)
        gain = F.pow(F.col(category) - expected, 2) / F.greatest(expected, F.lit(0.5))
        best = counts.select("mark", gain.alias("gain")).orderBy(F.desc("gain"), "mark").limit(marks).collect()
        chosen += [r["mark"] for r in best if r["mark"] not in chosen]
    return chosen


def fit_toxicity(labelled, text_col="text", categories=CATEGORIES, rows=ROWS):
    """(selected marks, chained models) from a table of texts with a 0/1 column for each category, or None if it is empty."""
    small_batches(labelled.sparkSession)
    clean = labelled.where(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0)
    for category in categories:
        clean = clean.where(F.col(category).isNotNull())
    order = F.xxhash64(text_col)
    picked = clean.select(
        F.col(text_col).alias("text"), *[F.col(c).cast("int").alias(c) for c in categories], order.alias("order"))
    # The first rows by hash, found without their texts; copies follow each other and count once.
    last = picked.select("order").distinct().orderBy("order").limit(rows).agg(F.max("order")).first()[0]
    if last is None:
        return None
    sample = stage(picked.where(F.col("order") <= last).groupBy("order").agg(
        F.min("text").alias("text"), *[F.max(c).alias(c) for c in categories]), "labelled")
    chosen = select_marks(sample, list(categories))

    def describe(batches):
        marks = Marks(chosen)
        for batch in batches:
            x, _ = feature_rows(batch.column(0).to_pylist(), marks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.tobytes() for row in x], pa.binary()), *batch.columns[1:]], names=["x", *categories, "order"])

    schema = ", ".join(["x binary", *[f"`{c}` int" for c in categories], "`order` long"])
    facts = sorted(sample.select("text", *categories, "order").mapInArrow(describe, schema).collect(), key=lambda r: r["order"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in facts])
    y = np.array([[r[c] for c in categories] for r in facts], dtype=np.float64)
    folds = np.array([r["order"] % FOLDS for r in facts])
    return chosen, fit_chain(x, y, folds)


def score_toxicity(docs, model, text_col="text", categories=CATEGORIES, prefix="p_"):
    """`docs` with a probability for each category, named `p_<category>`; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    names = [f"{prefix}{c}" for c in categories]
    docs = without(docs, names, [text_col])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    arrow_schema = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MARKS marks and weights per category

    def score(batches):
        known = shared.value
        marks = Marks(known[0]) if known else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            made = np.zeros((len(texts), len(names)))
            if known and texts:
                x, blank = feature_rows(texts, marks)
                made = np.where(blank[:, None], 0.0, run_chain(x, known[1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(made[:, i], pa.float64()) for i in range(len(names))]], schema=arrow_schema)

    return docs.mapInArrow(score, schema)


def labelled_documents(docs, labels, rows=ROWS):
    """Texts with their categories: `quality` 0 is low quality, `toxic` 1 is toxic.

    Of the labels with both categories and a text that is not blank, the `rows` that are first by a hash of their id are taken:
    ids meet ids for that, and texts are not shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(1 - F.col("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic")).dropna()
    written = docs.where(F.col("text").rlike(r"[^ \t-\r]")).select("doc_id").distinct()
    taken = known.join(written, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", *CATEGORIES)


def keep_clean(docs, model, threshold=REJECT, rejected="toxic"):
    """The documents whose probability in the category `rejected` is below the threshold."""
    prefix = "_p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scored = score_toxicity(docs, model, prefix=prefix)
    return scored.where(F.col(f"{prefix}{rejected}") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark, sf_dir, threshold=REJECT):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))
