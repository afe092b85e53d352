"""Removal of word sequences that already stand in a document with a smaller id.

Method: difference-cover anchors. The places p of a document's words with p mod 7 in {0, 1, 3} are its cover: for any two
places i and j there is a shift of at most 6 that takes both into the cover. Two equal windows of 13 words therefore share
an aligned anchor, the 7 words at that shift, so only anchors at cover places are hashed and compared over the corpus.
Windows that hold an anchor known from another document are then extended to their whole 13 words and compared by a
128-bit identity of which 96 bits travel; those also starting in a smaller document are removed.

Text is neither lower-cased nor otherwise changed; words are runs of bytes that are no ASCII white space. Null and empty
texts have no words. Repeated ids: rows of one id never remove each other's words. A null id counts as larger than any id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm import chunks
from policylens.llm.rolling import OVER_FIRST, OVER_SECOND, Texts, word_hashes

PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
NO_ID = (1 << 63) - 1
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType())])


class Words:
    """Words, anchors and window hashes of one chunk."""

    def __init__(self, table, window):
        self.texts = Texts(table["text"])
        self.starts, self.ends, (first, second) = word_hashes(self.texts.codes)
        self.row = self.texts.row_of(self.starts)
        self.begin = np.searchsorted(self.row, np.arange(len(self.texts.parts)))
        self.ids = np.array([NO_ID if k is None else k for k in table["key"].to_pylist()], dtype=np.int64)
        n = len(self.starts)
        self.window, self.first, self.second = window, first, second
        self.sums = OVER_FIRST.prefix(first)
        within = np.arange(n) - self.begin[self.row] if n else np.zeros(0, np.int64)
        whole = np.zeros(n, dtype=bool)
        whole[: max(0, n - ANCHOR + 1)] = self.row[: max(0, n - ANCHOR + 1)] == self.row[ANCHOR - 1:]
        self.places = np.flatnonzero(whole & np.isin(within % PERIOD, COVER))
        hashes = OVER_FIRST.stretches(self.sums, self.places, self.places + ANCHOR)
        order = np.lexsort((self.row[self.places], hashes))
        self.places, hashes = self.places[order], hashes[order]
        self.group = chunks.groups_of(hashes)
        lead = np.flatnonzero(np.diff(self.group, prepend=-1))
        tail = np.append(lead[1:], len(hashes)) - 1
        self.anchors = hashes[lead]
        rows = self.row[self.places]
        self.shared = rows[lead] != rows[tail] if len(lead) else np.zeros(0, dtype=bool)

    def candidates(self, marked):
        """Places of whole windows that hold a marked anchor, sorted by window identity and document id."""
        n, width = len(self.starts), self.window
        held = np.zeros(n, dtype=bool)
        places = self.places[marked[self.group]]
        for shift in range(PERIOD):
            at = places - shift
            at = at[at >= 0]
            held[at] = True
        whole = np.zeros(n, dtype=bool)
        whole[: max(0, n - width + 1)] = self.row[: max(0, n - width + 1)] == self.row[width - 1:]
        at = np.flatnonzero(held & whole)
        one = OVER_FIRST.stretches(self.sums, at, at + width)
        two = OVER_SECOND.stretches(OVER_SECOND.prefix(self.second), at, at + width).astype(np.uint32)
        ids = self.ids[self.row[at]]
        order = np.lexsort((ids, two, one))
        return at[order], one[order], two[order], ids[order]


def _ask_anchors(n, window):
    def ask(key, table):
        words = Words(chunks.in_order(table), window)

        def pack(part):
            flags = np.packbits(words.shared[part]).tobytes()
            return words.anchors[part].tobytes() + flags
        return chunks.bodies(key[0].as_py(), words.anchors, n, pack)
    return ask


def _anchor_count(body):
    """Entries of a body of 8 bytes and one bit each."""
    n = len(body) * 8 // 65
    while 8 * n + (n + 7) // 8 < len(body):
        n += 1
    return n


def _answer_anchors(table):
    """A bit for each anchor: does it start in two documents or more?"""
    if not table.num_rows:
        return chunks.ANSWERED_ARROW.empty_table()
    bodies = table["body"].to_pylist()
    counts = [_anchor_count(b) for b in bodies]
    keys = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, counts)])
    flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, offset=8 * n), count=n) for b, n in zip(bodies, counts)])
    order = np.argsort(keys, kind="stable")
    group = chunks.groups_of(keys[order])
    known = (np.bincount(group) > 1) | (np.bincount(group, weights=flags[order]) > 0)
    marks = np.empty(len(keys), dtype=bool)
    marks[order] = known[group]
    cuts = np.cumsum(counts)[:-1]
    return chunks.answers(table, 1, [np.packbits(m).tobytes() for m in np.split(marks, cuts)])


def _bits(bodies, total_cuts):
    """Bits of every body, whose entry counts are the differences of `total_cuts`."""
    out = np.zeros(total_cuts[-1] if len(total_cuts) else 0, dtype=bool)
    used = [b for b in range(len(total_cuts) - 1) if total_cuts[b + 1] > total_cuts[b]]
    for b, body in zip(used, bodies, strict=True):
        size = total_cuts[b + 1] - total_cuts[b]
        out[total_cuts[b]:total_cuts[b + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=size)
    return out


def _marked(words, table, n):
    return _bits(chunks.read_answers(table, 1), chunks.bucket_cuts(words.anchors, n))


def _ask_windows(n, window):
    def ask(key, docs, replies):
        if not docs.num_rows:
            return chunks.SENT_ARROW.empty_table()
        docs = chunks.in_order(docs)
        words = Words(docs, window)
        _, one, two, ids = words.candidates(_marked(words, replies, n))
        lead = np.flatnonzero(np.diff(chunks.groups_of(one, two), prepend=-1))
        one, two, ids = one[lead], two[lead], ids[lead]

        def pack(part):
            return one[part].tobytes() + two[part].tobytes() + chunks.planes(ids[part])
        return chunks.bodies(key[0].as_py(), one, n, pack)
    return ask


def _answer_windows(table):
    """A bit for each window: is its smallest id in the corpus smaller than in the asking chunk?"""
    if not table.num_rows:
        return chunks.ANSWERED_ARROW.empty_table()
    bodies = table["body"].to_pylist()
    counts = [len(b) // 20 for b in bodies]
    one = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, counts)])
    two = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(bodies, counts)])
    ids = np.concatenate([chunks.from_planes(b[12 * n:], n).view(np.int64) for b, n in zip(bodies, counts)])
    order = np.lexsort((ids, two, one))
    group = chunks.groups_of(one[order], two[order])
    least = ids[order][np.flatnonzero(np.diff(group, prepend=-1))]
    marks = np.empty(len(ids), dtype=bool)
    marks[order] = least[group] < ids[order]
    return chunks.answers(table, 2, [np.packbits(m).tobytes() for m in np.split(marks, np.cumsum(counts)[:-1])])


def _apply(n, window, arrow_schema):
    def apply(key, docs, replies):
        if not docs.num_rows:
            return arrow_schema.empty_table()
        docs = chunks.in_order(docs)
        words = Words(docs, window)
        at, one, two, ids = words.candidates(_marked(words, replies, n))
        group = chunks.groups_of(one, two)
        lead = np.flatnonzero(np.diff(group, prepend=-1))
        elsewhere = _bits(chunks.read_answers(replies, 2), chunks.bucket_cuts(one[lead], n))
        gone = elsewhere[group] | (ids[lead][group] < ids) if len(at) else np.zeros(0, dtype=bool)
        steps = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(steps, at[gone], 1)
        np.add.at(steps, at[gone] + window, -1)
        removed = np.cumsum(steps)[:-1] > 0
        begin = np.append(words.begin, len(words.starts))
        sums = np.concatenate(([0], np.cumsum(removed)))
        n_removed = sums[begin[1:]] - sums[begin[:-1]]
        kept = [b" ".join(_kept_words(words, i, removed[begin[i]:begin[i + 1]])) for i in range(len(words.texts.parts))]
        return pa.Table.from_arrays([
            docs["key"].combine_chunks(), docs["text"].combine_chunks(), docs["rest"].combine_chunks(),
            pa.array(np.diff(begin), pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array([k.decode("utf-8") for k in kept], pa.string())], schema=arrow_schema)
    return apply


def _kept_words(words, i, removed):
    parts = words.texts.parts[i].split()
    return parts if not removed.any() else [w for w, gone in zip(parts, removed) if not gone]


def remove_repeats(docs, id_col="doc_id", text_col="text", window=13, chunk_bytes=chunks.CHUNK_BYTES):
    """Every row of `docs` with its columns in a struct `rest` and n_words, n_removed and kept_text beside `key`, `text`.

    `window` must be 13 words or more: an anchor has 7 and the cover needs shifts up to 6.
    """
    if window < ANCHOR + PERIOD - 1:
        raise ValueError(f"window must be at least {ANCHOR + PERIOD - 1} words")
    spark = docs.sparkSession
    chunks.small_batches(spark)
    dealt, n = chunks.deal(docs, id_col, text_col, chunk_bytes)
    lean = dealt.groupBy("chunk")
    sent = lean.applyInArrow(_ask_anchors(n, window), chunks.SENT)
    first = sent.groupBy("bucket").applyInArrow(_answer_anchors, chunks.ANSWERED)
    sent = lean.cogroup(first.groupBy("chunk")).applyInArrow(_ask_windows(n, window), chunks.SENT)
    second = sent.groupBy("bucket").applyInArrow(_answer_windows, chunks.ANSWERED)
    schema = T.StructType([*[dealt.schema[c] for c in ("key", "text", "rest")], *RESULT.fields])
    replies = first.unionByName(second)
    return lean.cogroup(replies.groupBy("chunk")).applyInArrow(
        _apply(n, window, to_arrow_schema(schema)), schema)


def substring_dedup(docs, id_col="doc_id", text_col="text", window=13):
    """One row per document: its id, n_words, n_removed and the kept words joined by one space."""
    return remove_repeats(docs.select(id_col, text_col), id_col, text_col, window).select(
        F.col("key").alias(id_col), "n_words", "n_removed", "kept_text")


def dedup_documents(docs, id_col="doc_id", text_col="text", window=13, chunk_bytes=chunks.CHUNK_BYTES):
    """The documents with repeated words taken out of their texts; untouched texts stay as they are."""
    result = remove_repeats(docs, id_col, text_col, window, chunk_bytes)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    made = {id_col: F.col("key").cast(docs.schema[id_col].dataType), text_col: text}
    return result.select(*[made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op3_substring_dedup(spark, sf_dir):
    """The contract of `documents`; the digest is taken of the kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
