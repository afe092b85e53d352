"""Document fingerprints that follow the edit distance: Order MinHash.

Method: the k-mers of a text (k code points) are numbered by occurrence, the first, second, .. of its kind, and each numbered
k-mer gets a hash. The hashes are dealt into `sketches` ranges; in each range the two smallest numbered k-mers are selected,
put back in the order in which they stand in the text, and the tuple is hashed. Moving a passage changes the order, repeating
one changes the numbers, so a coordinate survives where order and repetition do, which a plain MinHash does not see.

The likeness of two fingerprints is the share of equal coordinates among those that are not empty in both, and 1 if all
are. A text of less than k code points is one k-mer; null and empty texts have only empty coordinates.

The edited text of a document takes the next document's, by descending id, so texts are dealt by ranges of ids and read in
order; the first row of the next range is sent along with each range. Rows of one id follow each other by a hash of their text,
then by text, and ranges are of both, so that one id or its absence on many rows is divided like any others; a null id comes
after all others. Only rows equal in id and text stay in one range, where they are streamed.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm.chunks import small_batches, without
from policylens.llm.rolling import OVER_FIRST, mix

SKETCHES, KMER, PICKED, SLICE_BYTES, SAMPLE_PER_CUT = 32, 5, 2, 32 << 20, 32
NO_ID = -(1 << 63)


def sketch(text, sketches=SKETCHES, k=KMER, picked=PICKED):
    """Coordinates of a text as 32-bit numbers; 0 stands for an empty one. `sketches` is a power of two."""
    out = np.zeros(sketches, dtype=np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return out
    symbols = mix(codes.astype(np.uint64) + np.uint64(1))
    sums = OVER_FIRST.prefix(symbols)
    kinds = OVER_FIRST.windows(sums, min(k, len(codes)))
    bits = np.uint64(max(20, len(kinds).bit_length()))
    place = np.arange(len(kinds), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    ordered = np.sort((kinds & ~low) | place)  # equal k-mers side by side, in text order
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = (ordered[1:] >> bits) != (ordered[:-1] >> bits)
    index = np.arange(len(ordered))
    number = index - np.maximum.accumulate(np.where(new, index, 0))
    hashes = mix((ordered >> bits) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ranked = np.sort((hashes & ~low) | (ordered & low))
    shift = np.uint64(64 - (sketches.bit_length() - 1))
    begin = np.searchsorted(ranked, np.arange(sketches, dtype=np.uint64) << shift)
    end = np.append(begin[1:], len(ranked))
    chosen = begin[:, None] + np.arange(picked)[None, :]
    there = chosen < end[:, None]
    places = np.where(there, ranked[np.minimum(chosen, len(ranked) - 1)] & low, low).astype(np.int64)
    places.sort(axis=1)
    there = np.arange(picked)[None, :] < there.sum(axis=1)[:, None]
    mixed = np.full(sketches, 7, dtype=np.uint64)
    for i in range(picked):
        step = mix(mixed * np.uint64(31) + kinds[np.minimum(places[:, i], len(kinds) - 1)])
        mixed = np.where(there[:, i], step, mixed)
    return np.where(there[:, 0], np.maximum(mixed >> np.uint64(32), 1), 0).astype(np.uint32)


def likeness(a, b):
    """Share of equal coordinates, 0 to 1."""
    used = (a > 0) | (b > 0)
    return float(np.count_nonzero((a == b) & used) / np.count_nonzero(used)) if used.any() else 1.0


def edited(text, following):
    """The last half of the text replaced by as many code points from the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs, text_col="text", name="fingerprint", sketches=SKETCHES):
    """`docs` and the fingerprint of each whole text in hex; a column of that name is replaced."""
    docs = without(docs, [name], [text_col])
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    arrow_schema = to_arrow_schema(schema)

    def add(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            made = [sketch(t or "", sketches).byteswap().tobytes().hex() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], schema=arrow_schema)

    return docs.mapInArrow(add, schema)


def _number(cuts):
    """How many of the ascending (back, hash) `cuts` are at or before a row, by halving steps over two constant arrays."""
    backs, hashes = (
        F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def step(passed, width):
        to = passed + width
        back, hash_ = F.get(backs, to - 1), F.get(hashes, to - 1)  # null beyond the last cut
        return F.when((back < F.col("back")) | ((back == F.col("back")) & (hash_ <= F.col("hash"))), to).otherwise(passed)
    return F.aggregate(steps, F.lit(0), step)


def _slices(keyed, slice_bytes):
    """Rows with the number of their range, and for each range (its first row's back and hash, the range before it).

    There is a range for each shuffle partition, or fewer where it would hold less than `slice_bytes`. Cuts come from a sample
    of rows. Rows of a range are streamed, so its size is no bound.
    """
    rows, size = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long") + 64)).first()
    most = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, cuts = max(1, min(most, 1 + (size or 0) // slice_bytes)), []
    if n > 1:
        drawn = sorted(tuple(r) for r in keyed.where(F.rand(SAMPLE_PER_CUT) < n * SAMPLE_PER_CUT / rows).select("back", "hash").collect())
        cuts = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []
    sliced = keyed.withColumn("slice", _number(cuts) if cuts else F.lit(0))
    heads = sorted(sliced.groupBy("slice").agg(F.min(F.struct("back", "hash")).alias("head")).collect())
    # The first row of a range follows the last of the range before; that of the first range follows the last of all.
    follows = [(*r["head"], heads[i - 1]["slice"]) for i, r in enumerate(heads)]
    return sliced, follows, len(cuts) + 1


def neighbours(docs, each, schema, id_col="doc_id", text_col="text", slice_bytes=SLICE_BYTES):
    """Rows made by `each(id, text, text of the next document)`, texts "" where null.

    Documents are in descending order of ids, and the first follows the last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(
        F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).alias("back"),  # ascends as ids descend
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sliced, follows, n = _slices(keyed, slice_bytes)
    arrow_schema = to_arrow_schema(schema)
    if follows:
        heads = F.broadcast(spark.createDataFrame(follows, "head long, head_hash long, target int"))  # a row per range
        targets = F.array_compact(F.array(
            F.struct(F.col("slice").alias("slice"), F.lit(False).alias("guest")),
            F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("slice"), F.lit(True).alias("guest")))))
        is_head = (F.col("back") == F.col("head")) & (F.col("hash") == F.col("head_hash"))
        sliced = sliced.join(heads, is_head, "left").select(
            F.explode(targets).alias("t"), "back", "hash", "id", "text").select("t.slice", "t.guest", "back", "hash", "id", "text")
    else:
        sliced = sliced.withColumn("guest", F.lit(False))

    def run(batches):
        made, waiting, size = [], None, 0

        def table():
            columns = list(zip(*made)) if made else [()] * len(arrow_schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                place, guest, id_, text = row
                if waiting is not None and waiting[0] == place:
                    made.append(each(waiting[1], waiting[2], text))
                waiting = None if guest else (place, id_, text)
                if len(made) >= 256:
                    yield table()
                    made = []
        yield table()

    return (
        sliced.repartitionById(n, F.col("slice"))
        .sortWithinPartitions("slice", "guest", "back", "hash", "text").select("slice", "guest", "id", "text")
        .mapInArrow(run, schema))


def edit_report(docs, id_col="doc_id", text_col="text", sketches=SKETCHES):
    """Each document's fingerprint beside those of its edited text and of the next document."""
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType())])
    last = {}

    def each(id_, text, following):
        own = last["sketch"] if last.get("text") is text else sketch(text, sketches)
        next_one = sketch(following, sketches)
        last.update(text=following, sketch=next_one)
        changed = edited(text, following)
        changed_one = sketch(changed, sketches)
        return (
            id_, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), own.byteswap().tobytes().hex(),
            changed_one.byteswap().tobytes().hex(), likeness(own, changed_one), likeness(own, next_one))

    return neighbours(docs, each, schema, id_col, text_col)


def op9_order_minhash(spark, sf_dir):
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
