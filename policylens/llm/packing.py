"""Packing of token sequences with certified numbers of bins.

Method: bound-certified repacking. Pieces are dealt to partitions and each is packed by best-fit decreasing. Dual-feasible
functions give a lower bound for the number of bins, of a partition and of all pieces together: what needs no more is
certified. While the total exceeds the bound, partitions exchange documents: the pieces of all bins with room left are dealt
anew, to partitions of up to twice the rows (16 times the first at most, what a task can hold), and best-fit decreasing runs
again. It ends when the total is certified, when one partition holds all that is left, after `PATIENCE` rounds of the largest
partitions that save no bin, or after `ROUNDS`; the round with the fewest bins counts. A partition that is certified by itself
takes part as well, as its last bin has room. Full bins never move.

Null and repeated ids are packed like any others: pieces are dealt by a number of their own, given when they are first
stored, so that neither one id nor copies of one row fill a partition. Pieces of one length are taken by id, then piece.

Texts are encoded part by part: the vocabulary splits a text into runs of letters, digits, other characters and contractions
and drops white space, no token crosses these borders, so the tokens of a text are those of its parts one behind the other,
and a part is encoded once per worker. Whole texts count; null and empty ones have just the closing id. Only documents longer
than a sequence are cut.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm.chunks import small_batches
from policylens.llm.token_counts import byte_alphabet
from policylens.sources.staging import stage

VOCABULARY, CAPACITY, CLOSING, PARTITION_ROWS, KEEP = "word_bpe_49k.json", 2048, 0, 50_000, 700_000
LARGEST, PATIENCE, ROUNDS = 4, 2, 32
PIECE = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PLACED = T.StructType([
    *PIECE.fields, T.StructField("salt", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("room", T.LongType()), T.StructField("bound", T.LongType()), T.StructField("bins", T.LongType()),
    T.StructField("part", T.LongType())])


# Texts of visible ASCII, small or capital Latin-1 letters and ASCII white space: composed, and lower-cased alike everywhere.
# The library's splitting pattern, fixed by the vocabulary file, reads on them as below once they are lower-cased.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\t-\r ]*")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^a-z0-9ß-öø-ÿ\t-\r ]+")


class Numbers(dict):
    """Numbers of keys, given in the order of their first use, when `learn` is called with the key."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        self.learn(key)
        number = self[key] = len(self)
        return number


class Words:
    """Ids of texts from those of their parts, each encoded once: the parts of the splitting pattern where a text is plain,
    else words as a whole. A word is a run of bytes without ASCII white space; its key begins with a blank, as no part does."""

    def __init__(self, path, keep=KEEP):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spelling = {b: c for c, b in byte_alphabet().items()}
        self._clear()

    def _clear(self):
        self.number, self.flat, self.counts = Numbers(self._learn), [], []
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, key):
        """Whatever is not plain goes through the whole library."""
        if key[0] == " ":
            ids = self.tokenizer.encode(key[1:], add_special_tokens=False).ids
        else:
            spelled = key if key.isascii() else "".join(map(self.spelling.__getitem__, key.encode("utf-8")))
            ids = [t.id for t in self.model.tokenize(spelled)]
        self.flat += ids
        self.counts.append(len(ids))

    def _plain(self, text):
        return PLAIN.fullmatch(text) and not any(special in text for special in self.special)

    def _keys(self, text):
        if self._plain(text):
            return PARTS.findall(text.lower())
        keys = []
        for word in text.encode("utf-8").split():
            word = word.decode("utf-8")
            keys += PARTS.findall(word.lower()) if self._plain(word) else [" " + word]
        return keys

    def _numbers(self, text):
        keys = self._keys(text)
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts):
        """Ids of each text."""
        if len(self.number) > self.keep:
            self._clear()
        numbers = [self._numbers(t) for t in texts]
        if self.counts:
            self.ids = np.concatenate([self.ids, np.array(self.flat, np.uint32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(self.counts)])
            self.flat, self.counts = [], []
        for number in numbers:
            begin = self.begin[number]
            counts = self.begin[number + 1] - begin
            ends = np.cumsum(counts)
            yield self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + counts, counts)]


_words = {}


def words_of(vocabulary):
    if vocabulary not in _words:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _words[vocabulary] = Words(path)
    return _words[vocabulary]


def pieces_of(docs, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, capacity=CAPACITY):
    """(key, piece, start, length, ids_crc32) of every piece of every document, closed by id 0."""
    small_batches(docs.sparkSession)
    arrow_schema = to_arrow_schema(PIECE)

    def cut(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for key, ids in zip(keys, words_of(vocabulary).encode([t or "" for t in texts])):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    rows.append((key, i, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) if rows else [()] * len(arrow_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECE)


def lower_bound(sizes, counts, capacity):
    """Bins that any packing needs: the best bound of dual-feasible functions, and of the volume.

    `sizes` are different and ascending. The first family rounds pieces above capacity - t up to a bin and drops those
    below t, for each t up to half a bin; the second rounds to multiples of 1/k.
    """
    if not len(sizes):
        return 0
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    volume = np.concatenate(([0], np.cumsum(sizes * counts)))
    number = np.concatenate(([0], np.cumsum(counts)))
    best = -(-int(volume[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        low, high = np.searchsorted(sizes, t), np.searchsorted(sizes, capacity - t, side="right")
        filled = capacity * int(number[-1] - number[high]) + int(volume[high] - volume[low])
        best = max(best, -(-filled // capacity))
    for k in range(1, 51):
        scaled = sizes * (k + 1)
        rounded = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((rounded * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity):
    """(bin, offset) of each length: the longest first, each into the fullest bin that has room for it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room, rooms, opened = {}, 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, opened
            opened += 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            if not by_room.setdefault(left, []):
                rooms |= 1 << left
            by_room[left].append(at)
    return bins, offsets


def _pack(capacity):
    schema = to_arrow_schema(PLACED)

    def pack(key, table):
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), table["key"].fill_null(-1).to_numpy()))
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        bins[order], offsets[order] = best_fit_decreasing(lengths[order], capacity)
        number = int(bins.max()) + 1
        room = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        n = len(lengths)
        return pa.Table.from_arrays([
            *[table[c].combine_chunks() for c in (*PIECE.names, "salt")], pa.array(bins), pa.array(offsets), pa.array(room[bins]),
            pa.array([bound] * n, pa.int64()), pa.array([number] * n, pa.int64()),
            pa.array([key[0].as_py()] * n, pa.int64())], schema=schema)
    return pack


def pack_pieces(pieces, capacity=CAPACITY, partition_rows=PARTITION_ROWS):
    """(placed pieces with `round`, `part`, `bin`, `offset`; number of bins; lower bound).

    A bin is named by (round, part, bin).
    """
    small_batches(pieces.sparkSession)
    pieces = stage(pieces.withColumn("salt", F.monotonically_increasing_id()), "pieces")
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # one row per length
    bound = lower_bound([r["length"] for r in histogram], [r["n"] for r in histogram], capacity)
    rows = sum(r["n"] for r in histogram)
    parts = max(1, math.ceil(rows / partition_rows))
    settled, open_, bins, round_no, stale, best = [], pieces, 0, 0, 0, None
    while True:
        dealt = open_.select(
            *PIECE.names, "salt", F.pmod(F.xxhash64("salt", F.lit(round_no)), F.lit(parts)).cast("long").alias("p"))
        placed = stage(dealt.groupBy("p").applyInArrow(_pack(capacity), PLACED), "packed").withColumn(
            "round", F.lit(round_no).cast("long"))
        facts = placed.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()
        total = bins + (facts[0] or 0)
        if best is None or total < best[1]:
            best, stale = ([*settled, placed], total), 0
        elif round_no >= LARGEST:
            stale += 1
        if parts == 1 or total <= bound or stale == PATIENCE or round_no + 1 == ROUNDS:
            return _all(best[0]), best[1], bound
        # With the total above the bound some room must be wasted: whatever still has room is dealt anew.
        full = placed.where("room = 0")
        settled.append(full)
        bins += full.groupBy("part", "bin").agg(F.lit(1)).count()
        open_ = placed.where("room > 0").select(*PIECE.names, "salt")
        round_no += 1
        parts = max(1, math.ceil(open_.count() / (partition_rows << min(round_no, LARGEST))))


def _all(frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pack_documents(docs, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, capacity=CAPACITY):
    """One row per piece: its document, place in it, length, checksum of its ids, sequence and place there."""
    placed, _, _ = pack_pieces(pieces_of(docs, id_col, text_col, vocabulary, capacity), capacity)
    # Rounds are below 2^5, partitions below 2^24, and bins of one below 2^33: the three numbers fit into one.
    sequence = F.col("round") * (1 << 57) + F.col("part") * (1 << 33) + F.col("bin")
    return placed.select(
        F.col("key").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def op4_best_fit_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
