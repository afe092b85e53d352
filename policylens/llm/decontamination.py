"""Benchmark passages in documents.

Method: a window of an item's size (in words) is slid over the documents; windows and items get SimHash fingerprints of their
five-word shingles, every occurrence counting. Items are indexed by the 8 blocks of their fingerprint: two fingerprints that
differ in at most `radius` bits differ in at most radius / 8 bits of some block, so looking up each block of a window with
that tolerance finds all items within the radius. Candidates are verified by the weighted Jaccard similarity of the shingles
themselves (occurrences shared by all occurrences of either), and count from 0.8 on.

A window without any shingle of an item has similarity 0 with it, so only windows that hold one are fingerprinted. The radius
is 20 of 64 bits (a similarity of 0.8 leaves 10 on average), but one shingle that an item repeats moves many bits, and no
radius below 64 is a guarantee. So windows whose count of shared shingle hashes reaches 0.8 are candidates as well, at any
distance; that count is never below the true one, and no pair is lost. Words are runs of bytes that are no ASCII white space, A-Z lower-cased. An item of fewer than five words is one
shingle. Documents shorter than an item are one window. Null, blank texts and items match nothing, and an item without an id
is left out. Of each document and item the best window is reported, the first of equal ones; rows of one id are reported each.

Items are read in blocks of about `block_bytes`, each of which is sent to all tasks and meets all documents.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm.chunks import small_batches
from policylens.llm.rolling import FIRST, OVER_FIRST, Texts, word_hashes

SHINGLE, SIMILARITY, RADIUS, BLOCKS, BLOCK_BYTES, AT_ONCE = 5, 0.8, 20, 8, 4 << 20, 4096
FOUND = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("n_bits", T.IntegerType()),
    T.StructField("similarity", T.DoubleType())])


def shingles(words, width):
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def weighted_similarity(a, b):
    """Shared occurrences by all occurrences of two counters."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def bit_sums(hashes):
    """Running numbers of set bits, one column per bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def prints_of(sums, starts, width):
    """SimHash of `width` neighbouring shingles from each start."""
    majority = (sums[starts + width] - sums[starts]) * 2 > width
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class Index:
    """The items of one block."""

    def __init__(self, items, radius=RADIUS):
        self.radius = radius
        self.items = [(i, words) for i, text in items if (words := (text or "").encode("utf-8").lower().split())]
        self.sizes = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.widths = np.minimum(self.sizes, SHINGLE)
        self.counts = [shingles(w, int(n)) for (_, w), n in zip(self.items, self.widths)]
        owners, hashes, self.prints = [], [], np.zeros(len(self.items), np.uint64)
        for row, ((_, words), width) in enumerate(zip(self.items, self.widths)):
            codes = np.frombuffer(b" ".join(words), np.uint8)
            _, _, (named,) = word_hashes(codes, (FIRST,))
            own = OVER_FIRST.stretches(
                OVER_FIRST.prefix(named), np.arange(len(words) - width + 1), np.arange(width, len(words) + 1))
            self.prints[row] = prints_of(bit_sums(own), np.array([0]), len(own))[0]
            owners.append(np.full(len(own), row))
            hashes.append(own)
        self.by_width = {}
        for width in set(self.widths.tolist()):
            mine = [i for i, w in enumerate(self.widths) if w == width]
            keys, rows = np.concatenate([hashes[i] for i in mine]), np.concatenate([owners[i] for i in mine])
            order = np.lexsort((rows, keys))
            keys, rows = keys[order], rows[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
            keys, rows, times = keys[new], rows[new], np.diff(new, append=len(keys))
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[keys >> np.uint64(48)] = True
            self.by_width[width] = keys, rows, times, maybe
        # near[block][value, item]: is the block's value within radius / BLOCKS bits of the item's?
        values = np.arange(256, dtype=np.uint8)
        parts = self.prints.view(np.uint8).reshape(-1, 8)
        self.near = [np.bitwise_count(values[:, None] ^ parts[None, :, b]) <= radius // BLOCKS for b in range(BLOCKS)]

    def within(self, prints, rows):
        """(window, item row, differing bits) of all pairs within the radius, looked up by blocks."""
        parts = prints.view(np.uint8).reshape(-1, 8)
        hit = np.zeros((len(prints), len(rows)), dtype=bool)
        for b in range(BLOCKS):
            hit |= self.near[b][parts[:, b]][:, rows]
        at, item = np.nonzero(hit)
        bits = np.bitwise_count(prints[at] ^ self.prints[rows[item]])
        close = bits <= self.radius
        return at[close], rows[item[close]], bits[close]

    def search(self, texts, similarity=SIMILARITY):
        """(row, item row, start, words, bits, similarity) of the best window of each text and item."""
        if not self.items or not len(texts.codes):
            return []
        starts, _, (named,) = word_hashes(texts.codes, (FIRST,))
        owner = texts.row_of(starts)
        begin = np.searchsorted(owner, np.arange(len(texts.parts) + 1))
        sums, found = OVER_FIRST.prefix(named), {}
        for width, (keys, rows, times, maybe) in self.by_width.items():
            hashes = OVER_FIRST.stretches(sums, np.arange(max(0, len(named) - width + 1)), np.arange(width, len(named) + 1)) \
                if len(named) >= width else np.zeros(0, np.uint64)
            at = np.flatnonzero(maybe[hashes >> np.uint64(48)])
            at = at[owner[at] == owner[at + width - 1]]
            low, high = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], side="right")
            for text in np.unique(owner[at[high > low]]).tolist():
                mine = (owner[at] == text) & (high > low)
                self._search_text(
                    texts.parts[text].split(), text, hashes[begin[text]:begin[text + 1] - width + 1], width, rows, times,
                    at[mine] - begin[text], low[mine], high[mine], similarity, found)
        return [(text, row, *best) for (text, row), best in sorted(found.items())]

    def counted(self, held, entry, rows, times, n_starts, n, similarity):
        """(item row, first start, end, similarity) of stretches of windows alike by the hashes they share, best first.

        `held`: places of shingles in the text; `entry`: their places in the index; `n`: shingles in a window. Of a shingle
        that an item holds t times a window shares the first t, so an occurrence counts in the windows behind the t-th before.
        """
        order = np.lexsort((held, entry))
        held, entry = held[order], entry[order]
        before = np.maximum(np.arange(len(held)) - times[entry], -1)
        after = np.where((before >= 0) & (entry[before] == entry), held[before] + 1, 0)
        first, last = np.maximum(held - n + 1, after), np.minimum(held, n_starts - 1)
        some = first <= last
        items, number = np.unique(rows[entry[some]], return_inverse=True)
        base = number * (n_starts + 1)
        marks, of = np.unique(np.concatenate([base + first[some], base + last[some] + 1]), return_inverse=True)
        shared = np.cumsum(np.bincount(of, np.repeat([1, -1], len(base)), len(marks))).astype(np.int64)
        row = items[marks // (n_starts + 1)] if len(items) else marks
        alike = shared / (self.sizes[row] - self.widths[row] + 1 + n - shared)
        good = np.flatnonzero((shared > 0) & (alike >= similarity))
        good = good[np.lexsort((marks[good], -alike[good], row[good]))]
        begin = marks[good] % (n_starts + 1)
        return zip(row[good].tolist(), begin.tolist(), (begin + marks[good + 1] - marks[good]).tolist(), alike[good].tolist())

    def _search_text(self, words, text, hashes, width, rows, times, at, low, high, similarity, found):
        """Windows of one text around the places `at`, where shingles of items stand."""
        held = np.repeat(at, high - low)
        entry = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
        item = rows[entry]
        for size in np.unique(self.sizes[item]).tolist():
            span = min(size, len(words))
            places = np.unique(held[self.sizes[item] == size])
            of_size = np.unique(item[self.sizes[item] == size])
            first = np.maximum(places - (span - width), 0)
            last = np.minimum(places, len(words) - span)
            marks = np.zeros(len(words) - span + 2, dtype=np.int32)
            np.add.at(marks, first, 1)
            np.add.at(marks, last + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for cut in range(0, len(starts), AT_ONCE):
                part = starts[cut:cut + AT_ONCE]
                for run in np.split(part, np.flatnonzero(np.diff(part) > span) + 1):
                    local = hashes[run[0]:run[-1] + span - width + 1]
                    prints = prints_of(bit_sums(local), run - run[0], span - width + 1)
                    for k, row, bits in zip(*self.within(prints, of_size)):
                        start = int(run[k])
                        alike = weighted_similarity(self.counts[row], shingles(words[start:start + span], width))
                        best = found.get((text, int(row)))
                        if alike >= similarity and (best is None or alike > best[3]):
                            found[text, int(row)] = (start, span, int(bits), alike)
            own, n = self.sizes[item] == size, span - width + 1
            for row, begin, end, most in self.counted(held[own], entry[own], rows, times, len(words) - span + 1, n, similarity):
                for start in range(begin, end):
                    best = found.get((text, row))
                    if best is not None and (most, -start) <= (best[3], -best[0]):
                        break
                    alike = weighted_similarity(self.counts[row], shingles(words[start:start + span], width))
                    if alike >= similarity and (best is None or (alike, -start) > (best[3], -best[0])):
                        print_ = prints_of(bit_sums(hashes[start:start + n]), np.array([0]), n)[0]
                        found[text, row] = (start, span, int(np.bitwise_count(print_ ^ self.prints[row])), alike)


def item_blocks(items, id_col="item_id", text_col="text", block_bytes=BLOCK_BYTES):
    """Lists of (id, text), one list at a time; a list holds about `block_bytes` of text."""
    size = items.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == block).select(id_col, text_col).collect()
        yield sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1])


def _texts_at_once(column):
    """Slices of a column of about a million bytes, one text at least."""
    begin, size = 0, 0
    lengths = [0 if t is None else len(t) for t in column.to_pylist()]
    for i, length in enumerate(lengths):
        if i > begin and size + length > 1 << 20:
            yield slice(begin, i)
            begin, size = i, 0
        size += length
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def find_passages(docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", radius=RADIUS):
    """(doc id, item_id, start_word, n_words, n_bits, similarity) of the best window of each document and item."""
    small_batches(docs.sparkSession)
    arrow_schema = to_arrow_schema(FOUND)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    results = []
    for block in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, radius))  # of a block of bounded size

        def search(batches, shared=shared):
            for batch in batches:
                keys, rows = batch.column(0).to_pylist(), []
                for part in _texts_at_once(batch.column(1)):
                    index = shared.value
                    found = index.search(Texts(batch.column(1)[part], lower=True))
                    rows += [(keys[part.start + t], index.items[row][0], *rest) for t, row, *rest in found]
                columns = list(zip(*rows)) if rows else [()] * len(arrow_schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

        results.append(source.mapInArrow(search, FOUND))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("key", id_col)


def keep_clean(docs, items, text_col="text", item_id="item_id", item_text="text", radius=RADIUS):
    """The documents in which no item is found, with all their columns."""
    small_batches(docs.sparkSession)
    for block in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, radius))

        def clean(batches, shared=shared):
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text_col))
                keep = np.ones(batch.num_rows, dtype=bool)
                for part in _texts_at_once(column):
                    for text, *_ in shared.value.search(Texts(column[part], lower=True)):
                        keep[part.start + text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_bits")
