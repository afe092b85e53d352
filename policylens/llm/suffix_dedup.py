"""Removal of byte strings that start at two places of the corpus or more.

Method: shards of text are merged by iterative interleave refinement of their Burrows-Wheeler columns. A merged order of the
suffixes of all shards is refined by stable counting sorts on the symbol before each suffix, one step further left each time;
borders between unlike suffixes are carried along, so that after the last step the blocks of the order are the repeated
intervals, without a sort of whole suffixes. Suffixes that have become alone in their block leave the order at once.

Refining all bytes of a corpus would pass over it once per byte of the wanted length, so the shards that meet are cut down
first, without loss. Of the 200-byte windows in a string of 400 bytes the one with the smallest hash is its anchor; equal
strings have equal anchors at the same distance. The starts that share an anchor form a span of at most 600 bytes.
1. Every chunk sends its different (anchor, span identity) pairs. Spans that occur twice are repeated as they are, anchors
   that occur in one span only are not, and neither travels.
2. The spans of an anchor that differ are sent, one copy each, and merged. All their strings hold the anchor, so only the
   200 bytes around it need refinement steps.
3. Anchors with more than `crowd` different spans would fill a task. Their strings are counted by identity instead, each
   chunk sending each different one once.

Matches are of bytes (UTF-8), never cross documents and are judged on the input. Null and empty texts have no bytes. What is
kept may end inside a character and is returned as binary. Span and string identities have 96 bits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm import chunks
from policylens.llm.rolling import FIRST, SECOND, Texts, mix

LENGTH, ANCHOR, CROWD = 400, 200, 2_000
PIECE, ROWS_AT_ONCE = 1 << 17, 1 << 19
NONE, WHOLE, SENT, SENT_WHOLE, COUNTED, COUNTED_WHOLE = range(6)
RESULT = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType())])


def least_of_windows(keys, width):
    """Smallest of every `width` neighbours."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1: n])


class Spans:
    """The spans of one chunk; entries are the different ones, sorted by anchor and identity."""

    def __init__(self, table, length, anchor):
        self.length, self.anchor = length, anchor
        self.texts = Texts(table["text"])
        codes, lengths, offsets = self.texts.codes, self.texts.lengths, self.texts.offsets
        steps = np.zeros(len(codes) + 2, dtype=np.int8)
        long = lengths >= length
        steps[offsets[long]] += 1
        steps[offsets[long] + lengths[long] - length + 1] -= 1
        starts = np.cumsum(steps[:-1], dtype=np.int8) > 0
        found = [self._piece(codes, starts, at) for at in range(0, len(codes), PIECE)]
        found = [f for f in found if f is not None]
        names = ("anchors", "one", "two", "start", "count", "before")
        kinds = (np.uint64, np.uint64, np.uint32, np.int64, np.int64, np.int64)
        for i, (name, kind) in enumerate(zip(names, kinds)):
            setattr(self, name, np.concatenate([f[i] for f in found]).astype(kind) if found else np.zeros(0, kind))
        order = np.lexsort((self.two, self.one, self.anchors))
        for name in names:
            setattr(self, name, getattr(self, name)[order])
        self.entry = chunks.groups_of(self.anchors, self.one, self.two)
        self.lead = np.flatnonzero(np.diff(self.entry, prepend=-1))
        self.repeated = np.diff(np.append(self.lead, len(self.entry))) > 1
        self.keys = self.anchors[self.lead]

    def _piece(self, codes, starts, at):
        """Spans whose starts lie in the next PIECE bytes."""
        here = np.flatnonzero(starts[at:at + PIECE])
        if not len(here):
            return None
        part = codes[at:at + PIECE + self.length]
        sums = FIRST.prefix(part)
        hashes = FIRST.windows(sums, self.anchor)
        place = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        least = least_of_windows((hashes & ~low) | place, self.length - self.anchor + 1)
        chosen = (least[here] & low).astype(np.int64)
        new = np.ones(len(here), dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (here[1:] != here[:-1] + 1)
        lead = np.flatnonzero(new)
        count = np.diff(np.append(lead, len(here)))
        start, before = here[lead], chosen[lead] - here[lead]
        ends = start + count - 1 + self.length
        shape = (before * 1024 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        one = mix(FIRST.stretches(sums, start, ends) ^ shape)
        two = mix(SECOND.stretches(SECOND.prefix(part), start, ends) ^ shape).astype(np.uint32)
        # The smallest of many hashes are small: mixed again, they spread over all buckets.
        return mix(hashes[chosen[lead]]), one, two, start + at, count, before

    def strings(self, chosen):
        """(entry, start, identity in two parts) of every string in the chosen spans, sorted by identity."""
        rows = np.flatnonzero(chosen)
        start = np.repeat(self.start[rows], self.count[rows]) + _within(self.count[rows])
        entry = np.repeat(self.entry[rows], self.count[rows])
        one, two = np.empty(len(start), np.uint64), np.empty(len(start), np.uint32)
        order = np.argsort(start, kind="stable")
        place = start[order]
        at = 0
        while at < len(place):
            to = int(np.searchsorted(place, place[at] + PIECE))
            part = self.texts.codes[place[at]:place[to - 1] + self.length]
            local = place[at:to] - place[at]
            one[order[at:to]] = FIRST.stretches(FIRST.prefix(part), local, local + self.length)
            two[order[at:to]] = SECOND.stretches(SECOND.prefix(part), local, local + self.length).astype(np.uint32)
            at = to
        order = np.lexsort((two, one))
        return entry[order], start[order], one[order], two[order]


def _within(counts):
    """0, 1, .. for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _ask_spans(n, length, anchor):
    def ask(key, table):
        spans = Spans(chunks.in_order(table), length, anchor)
        one, two = spans.one[spans.lead], spans.two[spans.lead]

        def pack(part):
            return spans.keys[part].tobytes() + one[part].tobytes() + two[part].tobytes() + spans.repeated[part].tobytes()
        return chunks.bodies(key[0].as_py(), spans.keys, n, pack)
    return ask


def _answer_spans(crowd):
    def answer(table):
        """What to do with each span, as one byte."""
        if not table.num_rows:
            return chunks.ANSWERED_ARROW.empty_table()
        table = chunks.by_chunk(table)
        bodies = table["body"].to_pylist()
        counts = [len(b) // 21 for b in bodies]

        def column(kind, offset):
            return np.concatenate([np.frombuffer(b, kind, n, offset * n) for b, n in zip(bodies, counts)])
        keys, one, two, repeated = column(np.uint64, 0), column(np.uint64, 8), column(np.uint32, 16), column(np.bool_, 20)
        order = np.lexsort((two, one, keys))
        keys, one, two, repeated = keys[order], one[order], two[order], repeated[order]
        span = chunks.groups_of(keys, one, two)
        group = chunks.groups_of(keys)
        lead = np.diff(span, prepend=-1) > 0
        whole = ((np.bincount(span) > 1) | (np.bincount(span, weights=repeated) > 0))[span]
        kinds = np.bincount(group, weights=lead)[group]
        single = (np.bincount(group, weights=~whole) > 0)[group]
        code = np.where(whole, WHOLE, NONE).astype(np.uint8)
        meets = (kinds > 1) & single & lead
        code[meets & ~whole] = SENT
        code[meets & whole] = SENT_WHOLE
        code[meets & (kinds > crowd)] += COUNTED - SENT
        out = np.empty(len(code), dtype=np.uint8)
        out[order] = code
        return chunks.answers(table, 1, [c.tobytes() for c in np.split(out, np.cumsum(counts)[:-1])])
    return answer


def _codes(replies):
    return np.frombuffer(b"".join(chunks.read_answers(replies, 1)), np.uint8)


def _to_count(spans, code):
    """Strings of the spans that are counted, and which of the different ones are known to be repeated."""
    chosen = np.isin(code, (COUNTED, COUNTED_WHOLE))[spans.entry] if len(spans.entry) else np.zeros(0, bool)
    # A repeated span stands for all its copies.
    first = np.zeros(len(spans.entry), dtype=bool)
    first[spans.lead] = True
    entry, start, one, two = spans.strings(chosen & first)
    group = chunks.groups_of(one, two)
    lead = np.flatnonzero(np.diff(group, prepend=-1))
    known = (np.bincount(group) > 1) | (np.bincount(group, weights=code[entry] == COUNTED_WHOLE) > 0) if len(group) else group
    return entry, start, one[lead], two[lead], group, known


def _ask_strings(n, length, anchor):
    def ask(key, docs, replies):
        if not docs.num_rows:
            return chunks.SENT_ARROW.empty_table()
        docs = chunks.in_order(docs)
        spans = Spans(docs, length, anchor)
        code = _codes(replies)
        lead = spans.lead[np.isin(code, (SENT, SENT_WHOLE))]
        codes, start, count, before = spans.texts.codes, spans.start[lead], spans.count[lead], spans.before[lead]

        def pack(part):
            parts = [codes[s:s + c - 1 + length].tobytes() for s, c in zip(start[part].tolist(), count[part].tolist())]
            head = np.array([len(parts)], np.uint64).tobytes()
            return b"".join([head, spans.anchors[lead][part].tobytes(), count[part].astype(np.uint16).tobytes(),
                             before[part].astype(np.uint16).tobytes(), *parts])
        sent = chunks.bodies(key[0].as_py(), spans.anchors[lead], n, pack)
        _, _, one, two, _, known = _to_count(spans, code)
        if not len(one):
            return sent

        def pack_counted(part):
            return one[part].tobytes() + two[part].tobytes() + known[part].astype(np.bool_).tobytes()
        counted = chunks.bodies(key[0].as_py(), one, n, pack_counted)
        second = pa.array([b + n for b in counted["bucket"].to_pylist()], pa.int32())
        return pa.concat_tables([sent, counted.set_column(0, "bucket", second)])
    return ask


def merge_shards(shards, length, anchor):
    """Which strings of the spans in several shards are repeated.

    A shard is (anchors, counts, befores, bytes); the result has one array of booleans per shard, string by string. Anchors
    are independent of each other and are merged some at a time.
    """
    keys = np.concatenate([s[0] for s in shards])
    counts = np.concatenate([s[1] for s in shards]).astype(np.int64)
    befores = np.concatenate([s[2] for s in shards]).astype(np.int64)
    codes = np.frombuffer(b"".join(s[3] for s in shards), np.uint8)
    sizes = counts - 1 + length
    places = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    repeated = np.zeros(int(counts.sum()), dtype=bool)
    order = np.argsort(keys, kind="stable")
    borders = np.append(np.flatnonzero(np.diff(chunks.groups_of(keys[order]), prepend=-1)), len(order))
    rows_before = np.concatenate(([0], np.cumsum(counts[order])))[borders]
    at = 0
    while at < len(borders) - 1:
        to = max(at + 1, int(np.searchsorted(rows_before, rows_before[at] + ROWS_AT_ONCE)) - 1)
        some = order[borders[at]:borders[to]]
        repeated[_merge(codes, keys[some], counts[some], befores[some], places[some], first[some], length, anchor)] = True
        at = to
    totals = [int(s[1].astype(np.int64).sum()) for s in shards]
    return np.split(repeated, np.cumsum(totals)[:-1])


def _merge(codes, keys, counts, befores, places, first, length, anchor):
    """Numbers of the repeated strings of some anchors' spans.

    All strings of an anchor at one distance start in one block, ordered by shard. Every step takes two symbols further to
    the left; a stable counting sort by them refines the interleaving of the shards, and rows remain in one block if both
    the symbols and the blocks before were equal.
    """
    span = np.repeat(np.arange(len(counts)), counts)
    offset = _within(counts)
    distance = befores[span] - offset
    order = np.lexsort((distance, keys[span]))
    block = chunks.groups_of(keys[span][order], distance[order])
    row, end = (first[span] + offset)[order], (places[span] + offset + length)[order]
    right = (length - anchor - distance)[order]
    steps = length - anchor
    for step in range(0, steps, 2):
        symbol = np.zeros(len(row), dtype=np.uint16)
        for k in range(step, min(step + 2, steps)):
            # Beyond the right side the anchor is stepped over: it is known to be equal.
            symbol |= codes[end - 1 - k - np.where(k >= right, anchor, 0)].astype(np.uint16) << np.uint16(8 * (k - step))
        perm = np.argsort(symbol, kind="stable")
        row, end, right, block, symbol = row[perm], end[perm], right[perm], block[perm], symbol[perm]
        block = chunks.groups_of(symbol, block)
        if step % 16 == 0 or step + 2 >= steps:
            stays = np.bincount(block)[block] > 1 if len(block) else np.zeros(0, bool)
            row, end, right, block = row[stays], end[stays], right[stays], block[stays]
    return row


def _answer_strings(n, length, anchor):
    def answer(key, table):
        bodies = table["body"].to_pylist()
        if not bodies:
            return chunks.ANSWERED_ARROW.empty_table()
        if key[0].as_py() < n:
            shards = []
            for body in bodies:
                m = int(np.frombuffer(body, np.uint64, 1)[0])
                shards.append((
                    np.frombuffer(body, np.uint64, m, 8), np.frombuffer(body, np.uint16, m, 8 + 8 * m),
                    np.frombuffer(body, np.uint16, m, 8 + 10 * m), body[8 + 12 * m:]))
            found = merge_shards(shards, length, anchor)
        else:
            counts = [len(b) // 13 for b in bodies]
            one = np.concatenate([np.frombuffer(b, np.uint64, m) for b, m in zip(bodies, counts)])
            two = np.concatenate([np.frombuffer(b, np.uint32, m, 8 * m) for b, m in zip(bodies, counts)])
            known = np.concatenate([np.frombuffer(b, np.bool_, m, 12 * m) for b, m in zip(bodies, counts)])
            order = np.lexsort((two, one))
            group = chunks.groups_of(one[order], two[order])
            repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=known[order]) > 0)
            marks = np.empty(len(one), dtype=bool)
            marks[order] = repeated[group]
            found = np.split(marks, np.cumsum(counts)[:-1])
        return chunks.answers(table, 2, [np.packbits(f).tobytes() for f in found])
    return answer


def _spread(bodies, sizes):
    return np.concatenate([np.zeros(0, bool), *[
        np.unpackbits(np.frombuffer(b, np.uint8), count=int(m)).astype(bool) for b, m in zip(bodies, sizes, strict=True)]])


def _repeated_starts(spans, replies, n):
    """Starts of repeated strings in the chunk."""
    code = _codes(replies)
    code = code if len(code) else np.zeros(0, np.uint8)
    rows = replies.select(["round", "bucket", "body"]).to_pylist()
    second = sorted((r["bucket"], r["body"]) for r in rows if r["round"] == 2)
    chosen = np.isin(code[spans.entry], (WHOLE, SENT_WHOLE, COUNTED_WHOLE)) if len(spans.entry) else np.zeros(0, bool)
    found = [np.repeat(spans.start[chosen], spans.count[chosen]) + _within(spans.count[chosen])]

    lead = spans.lead[np.isin(code, (SENT, SENT_WHOLE))]
    starts = np.repeat(spans.start[lead], spans.count[lead]) + _within(spans.count[lead])
    cuts = chunks.bucket_cuts(spans.anchors[lead], n)
    total = np.concatenate(([0], np.cumsum(spans.count[lead])))
    sizes = [total[cuts[b + 1]] - total[cuts[b]] for b in range(n) if cuts[b + 1] > cuts[b]]
    found.append(starts[_spread([body for b, body in second if b < n], sizes)])

    _, start, one, _, group, _ = _to_count(spans, code)
    cuts = chunks.bucket_cuts(one, n)
    sizes = [cuts[b + 1] - cuts[b] for b in range(n) if cuts[b + 1] > cuts[b]]
    marks = _spread([body for b, body in second if b >= n], sizes)
    found.append(start[marks[group]] if len(group) else start)
    return np.concatenate(found)


def _apply(n, length, anchor, schema):
    def apply(key, docs, replies):
        if not docs.num_rows:
            return schema.empty_table()
        docs = chunks.in_order(docs)
        spans = Spans(docs, length, anchor)
        at = _repeated_starts(spans, replies, n)
        texts = spans.texts
        steps = np.zeros(len(texts.codes) + 1, dtype=np.int32)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + length, -1)
        gone = np.cumsum(steps[:-1]) > 0
        edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(begins, texts.offsets)
        last = np.searchsorted(begins, texts.offsets + texts.lengths)
        kept, cut = [], []
        for i, part in enumerate(texts.parts):
            low = int(texts.offsets[i])
            cut.append([{"start": int(b) - low, "end": int(e) - low} for b, e in zip(begins[first[i]:last[i]], ends[first[i]:last[i]])])
            kept.append(part if not cut[-1] else texts.codes[low:low + len(part)][~gone[low:low + len(part)]].tobytes())
        removed = texts.lengths - np.array([len(k) for k in kept], dtype=np.int64)
        return pa.Table.from_arrays([
            docs["key"].combine_chunks(), pa.array(texts.lengths, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(cut, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)
    return apply


def suffix_dedup(docs, id_col="doc_id", text_col="text", length=LENGTH, anchor=ANCHOR, crowd=CROWD,
                 chunk_bytes=chunks.CHUNK_BYTES):
    """One row per document: its id, n_bytes, n_removed, the removed `spans` in bytes, and the bytes `kept`."""
    if not 0 < length - anchor < 1024 or anchor < 1:
        raise ValueError("the anchor must be shorter than the string, by less than 1024 bytes")
    chunks.small_batches(docs.sparkSession)
    dealt, n = chunks.deal(docs.select(id_col, text_col), id_col, text_col, chunk_bytes)
    texts = dealt.groupBy("chunk")
    sent = texts.applyInArrow(_ask_spans(n, length, anchor), chunks.SENT)
    first = sent.groupBy("bucket").applyInArrow(_answer_spans(crowd), chunks.ANSWERED)
    sent = texts.cogroup(first.groupBy("chunk")).applyInArrow(_ask_strings(n, length, anchor), chunks.SENT)
    second = chunks.spread_buckets(sent).applyInArrow(_answer_strings(n, length, anchor), chunks.ANSWERED)
    replies = first.unionByName(second)
    return texts.cogroup(replies.groupBy("chunk")).applyInArrow(
        _apply(n, length, anchor, to_arrow_schema(RESULT)), RESULT).withColumnRenamed("key", id_col)


def op2_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
