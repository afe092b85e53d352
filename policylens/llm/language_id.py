"""Language of whole texts by a string kernel.

Method: the kernel of two texts is the number of blended-spectrum n-grams (1 to 3 code points, lower-cased) that both hold,
by presence, divided by the root of the product of their numbers. Nystroem landmarks approximate it: a text is described by
its kernels with the landmarks, times the inverse root of the landmarks' own kernel matrix. One ridge regression per language
against the rest is solved in that space. As kernels with landmarks are products with their n-gram rows, landmark matrix,
inverse root and ridge weights multiply into one matrix from n-grams to languages, and a batch of texts is scored by one
matrix product. N-grams are hashed to 2^14 places.

The model is fitted on at most `rows` labelled texts, about as many of each language, chosen by a hash of their ids. Texts
that are null or hold no letter are `und` with score 0, and so is everything if there is nothing to learn from. The score is
the regression's value for the language, kept within 0 and 1.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm.chunks import small_batches, without
from policylens.llm.rolling import OVER_FIRST, mix

BITS, LONGEST, ROWS, LANDMARKS, RIDGE, SMOOTH = 14, 3, 4000, 128, 1e-2, 1e-6
PLACES = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 18


def gram_rows(texts, longest=LONGEST):
    """Presence of hashed n-grams, one row of booleans per text. Long texts are read in pieces that overlap."""
    out = np.zeros((len(texts), PLACES), dtype=bool)
    for row, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        for at in range(0, len(codes), PIECE):
            part = codes[at:at + PIECE + longest - 1].astype(np.uint64)
            sums = OVER_FIRST.prefix(mix(part + np.uint64(1)))
            for n in range(1, longest + 1):
                if len(part) >= n:
                    out[row, mix(OVER_FIRST.windows(sums, n) + np.uint64(n)) >> np.uint64(64 - BITS)] = True
    return out


def normalised(rows):
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def unpacked(packed):
    return normalised(np.unpackbits(packed, axis=1))


def fit_kernel_ridge(rows, languages, landmarks=LANDMARKS, ridge=RIDGE, at_once=256):
    """(classes, matrix from n-gram places to class scores, intercepts) from presence rows, plain or eight places to a byte.

    Rows are unpacked some at a time; what stays of each is its kernels with the landmarks.
    """
    rows = np.packbits(rows, axis=1) if rows.dtype == bool else rows
    classes = sorted(set(languages))
    chosen = unpacked(rows[np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int)])
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + SMOOTH * max(1.0, values.max()))) @ vectors.T
    kernels = np.concatenate([unpacked(rows[at:at + at_once]) @ chosen.T for at in range(0, len(rows), at_once)])
    space = kernels.astype(np.float64) @ root
    target = (np.array(languages)[:, None] == np.array(classes)[None, :]).astype(np.float64)
    mean, level = space.mean(axis=0), target.mean(axis=0)
    centred = space - mean
    weights = np.linalg.solve(
        centred.T @ centred + ridge * len(rows) / len(chosen) * np.eye(len(chosen)), centred.T @ (target - level))
    return classes, (chosen.T @ (root @ weights).astype(np.float32)), level - mean @ weights


def sample_rows(labelled, id_col, text_col, lang_col, rows=ROWS):
    """At most `rows` texts with a language, about as many of each, by a hash of their ids and texts.

    Rows are chosen by language and hash alone; texts are read for the chosen ones and never shuffled.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("order"))
    narrow = usable.select("lang", "order")
    counts = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = rows / max(1, counts.count())
    picked = narrow.join(counts, "lang").where(F.pmod("order", F.lit(1_000_000)) * F.col("n") < each * 1_000_000)
    chosen = [r["order"] for r in picked.select("order").distinct().orderBy("order").limit(rows).collect()]
    if not chosen:
        return usable.limit(0)
    keys = labelled.sparkSession.createDataFrame([(c,) for c in chosen], "order long")  # at most `rows` numbers
    return usable.join(F.broadcast(keys), "order").dropDuplicates(["order"]).select("text", "lang", "order").orderBy("order", "lang")


def fit_language_model(labelled, id_col="doc_id", text_col="text", lang_col="lang", rows=ROWS):
    """The model, or None without labelled texts. The sample's n-gram rows, 2 KB each, come to the driver."""
    small_batches(labelled.sparkSession)

    def pack(batches):
        for batch in batches:
            packed = [np.packbits(gram_rows([t])[0]).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), batch.column(1)], names=["grams", "lang"])

    sample = sample_rows(labelled, id_col, text_col, lang_col, rows).select("text", "lang").mapInArrow(
        pack, "grams binary, lang string").collect()
    if not sample:
        return None
    packed = np.stack([np.frombuffer(r["grams"], np.uint8) for r in sample])
    return fit_kernel_ridge(packed, [r["lang"] for r in sample])


def predict_language(docs, model, text_col="text", batch_rows=256):
    """`docs` with `lang_pred` and `score`; columns of these names are replaced."""
    docs = without(docs, ["lang_pred", "score"], [text_col])
    small_batches(docs.sparkSession, batch_rows)
    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB per language

    def score(batches):
        known = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if known else []
            if rows:
                classes, matrix, level = known
                values = normalised(gram_rows([texts[i] for i in rows])) @ matrix + level
                best = values.argmax(axis=1)
                for i, b, v in zip(rows, best.tolist(), values.max(axis=1).tolist()):
                    names[i], scores[i] = classes[b], min(1.0, max(0.0, v))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=arrow_schema)

    return docs.mapInArrow(score, schema)


def held_out(id_col="doc_id"):
    """Documents that no model learns from; a null id is not held out and not learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")
