"""Near duplicates by SimHash fingerprints at a small Hamming distance.

Method: pivot distance tables. The distances of every fingerprint to the reference fingerprints are computed once; the
distance of two fingerprints is at least the largest difference of their coordinates, so pairs beyond the limit are discarded
from the table and only the survivors are compared bit by bit.

Coordinates of nearly random fingerprints all lie close to 32, so they can discard pairs but cannot deal fingerprints to
tasks. Pairs are therefore first brought together by equal parts: with at most d differing bits and d + k parts, k parts at
least are equal. Fingerprints are made distinct first, a group of pairs that share parts leaves its task as a spanning
forest, and a group of more than `group_limit` fingerprints is linked through common neighbours instead: two fingerprints
within d bits both lie within (d + 1) / 2 bits of some third, so every fingerprint names those and joins the smallest that
names the same. No link is lost either way.

Texts: A-Z is lower-cased, words are runs of bytes that are no ASCII white space, shingles are joined by a space; a text of
fewer words is one shingle; null, empty and blank texts have fingerprint 0, which links like any other. A null id is ignored
when the smallest id of a group is sought.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.llm.chunks import free_name, small_batches
from policylens.llm.components import connected
from policylens.sources.staging import stage

BITS, PIVOTS, GROUP_SIZE, GROUP_LIMIT, ROWS_AT_ONCE = 64, 16, 64, 20_000, 1 << 16


def fingerprint(text, shingle=4, seed=42):
    """SimHash of a text as an unsigned number."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    numbers = np.array(hashes, dtype=np.uint64)
    for at in range(0, len(numbers), 1 << 14):
        part = numbers[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(numbers), bitorder="little").tobytes(), "little")


def with_fingerprints(docs, text_col="text", name="fp", shingle=4):
    """`docs` and the fingerprint of each whole text as a signed 64-bit column."""
    small_batches(docs.sparkSession)

    def add(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            prints = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def pivots(n=PIVOTS, seed=5):
    """Reference fingerprints: fixed random numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % 2


def pivot_table(prints, references):
    """Distances of each fingerprint to each reference, one column per reference."""
    return np.stack([np.bitwise_count(prints ^ r) for r in references], axis=1).astype(np.int8)


def forest(prints, groups, distance, references):
    """Index pairs that link the same fingerprints as all pairs of one group within `distance`.

    `groups` is sorted. Row i meets row i + 1 of its group, then i + 2, and so on, all groups at once; pairs that are
    already linked are not looked at again.
    """
    table = pivot_table(prints, references)
    end = np.searchsorted(groups, groups, side="right")
    root = np.arange(len(prints))
    kept, rows, shift = [], np.arange(len(prints)), 0
    while True:
        shift += 1
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            return kept
        left = rows[root[rows] != root[rows + shift]]
        near = np.abs(table[left] - table[left + shift]).max(axis=1, initial=0) <= distance
        left = left[near]
        left = left[np.bitwise_count(prints[left] ^ prints[left + shift]) <= distance]
        if len(left):
            for a in left.tolist():
                ra, rb = int(root[a]), int(root[a + shift])
                while root[ra] != ra:
                    ra = int(root[ra])
                while root[rb] != rb:
                    rb = int(root[rb])
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    kept.append((a, a + shift))
            while not np.array_equal(root, root[root]):
                root = root[root]


def _masks(parts, equal):
    edges = [BITS * i // parts for i in range(parts + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(parts)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(parts), equal)]


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _neighbours(reach):
    """Masks of up to `reach` bits."""
    return [_signed(sum(1 << b for b in bits)) for k in range(reach + 1) for bits in combinations(range(BITS), k)]


def parts_for(n, distance, group_size=GROUP_SIZE):
    """The fewest parts whose equal ones tell `n` random fingerprints into groups of about `group_size` or less."""
    parts = distance + 2
    while parts < 2 * distance + 2 and n > group_size << (BITS * (parts - distance) // parts):
        parts += 1
    return parts


def links(prints, distance=4, parts=None, group_limit=GROUP_LIMIT):
    """Edges (a, b) between distinct fingerprints `fp` that have the same components as all pairs within `distance`.

    The number of parts only decides how the pairs are brought together; any number above `distance` finds the same.
    """
    small_batches(prints.sparkSession)
    parts = parts or parts_for(prints.count(), distance)
    equal = parts - distance
    if equal < 1:
        raise ValueError("more parts than differing bits are needed")
    masks = _masks(parts, equal)
    keys = F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.value")
    large = keyed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit)
    references = pivots()

    def linked(batches):
        """Rows come sorted by group; whole groups are taken together until there are enough of them."""
        held = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) >= ROWS_AT_ONCE:
                tail = held.iloc[-1]
                open_ = ((held["part"] == tail["part"]) & (held["value"] == tail["value"])).to_numpy()
                yield _edges(held[~open_], distance, references)
                held = held[open_]
        if held is not None:
            yield _edges(held, distance, references)

    small = (
        keyed.join(large, ["part", "value"], "left_anti").repartition("part", "value")
        .sortWithinPartitions("part", "value").mapInArrow(linked, "a long, b long"))
    shifts = F.array(*[F.lit(m) for m in _neighbours((distance + 1) // 2)])
    third = (
        keyed.join(large, ["part", "value"], "left_semi").select("fp").distinct()
        .select("fp", F.explode(shifts).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("third")))
    least = third.groupBy("third").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("third", "a")
    crowded = third.join(least, "third").select("a", F.col("fp").alias("b")).where("a < b")
    return small.unionByName(crowded).distinct()


def _edges(frame, distance, references):
    prints = frame["fp"].to_numpy().view(np.uint64)
    new = (frame["part"].diff() != 0) | (frame["value"].diff() != 0)
    pairs = np.array(forest(prints, np.cumsum(new.to_numpy()), distance, references), dtype=np.int64).reshape(-1, 2)
    ends = frame["fp"].to_numpy()[pairs]
    return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])


def _prints(docs, id_col, text_col, shingle):
    """(id, text_hash, row_hash, fp) of each row."""
    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"),
        F.xxhash64(id_col, text_col).alias("row_hash"))
    return with_fingerprints(source, "text", "fp", shingle).drop("text")


def _labelled(prints, distance):
    """(fingerprint, component, first row of the component) for each fingerprint, and the first row of each component.

    What is stored is one row per fingerprint, made in one pass over `prints`.
    """
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"), F.col("row_hash"))
    distinct = stage(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    members = connected(stage(links(distinct.select("fp"), distance), "links"))
    of_print = distinct.join(members, distinct.fp == members.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    firsts = of_print.groupBy("component").agg(F.min("first").alias("first"))
    return of_print.select("fp", "component").join(firsts, "component"), firsts


def near_duplicates(docs, id_col="doc_id", text_col="text", distance=4, shingle=4):
    """(id, fp, component_id) for each row: the smallest id whose fingerprint is reached by links, null if there is none."""
    prints = stage(_prints(docs, id_col, text_col, shingle), "fingerprints")
    labels, _ = _labelled(prints, distance)
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def keep_one(docs, id_col="doc_id", text_col="text", distance=4, shingle=4):
    """One row of each group of linked texts: that of the smallest id, and among rows of one id of the smallest text hash."""
    _, firsts = _labelled(_prints(docs, id_col, text_col, shingle), distance)
    of_text = free_name(docs.columns, "_text_hash")
    of_row = free_name(docs.columns, "_row_hash")
    kept = firsts.select(F.col("first.text_hash").alias(of_text), F.col("first.row_hash").alias(of_row))
    hashed = docs.withColumns({of_text: F.xxhash64(text_col), of_row: F.xxhash64(id_col, text_col)})
    # One shuffle of the texts serves the join and the choice among equal rows.
    return hashed.join(kept, [of_text, of_row], "left_semi").dropDuplicates([of_text, of_row]).select(*[
        F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
