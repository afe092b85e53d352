"""Periodic runs of words, found on a grammar of each text.

Method: the words of a text are numbered and compressed by Re-Pair. A rule is a pair of shorter strings, and a run that lies
in the rule's string but in neither part crosses the boundary between them; runs that cross it are computed once for each
rule, at one place where the rule stands, and carried to all places that the derivation gives the rule. Every run of the text
is found whole at the smallest rule that holds it; what longer rules cut off at their ends lies inside a run of the same
period and goes when intervals are merged.

Pairs are taken by count, those of the highest power of two of a text first; where two of them overlap the more frequent one
wins. When no pair is left twice, neighbours are joined to a balanced tree, so that the grammar has one start symbol. All
texts of a batch are compressed side by side as arrays; no rule is shared by two texts.

Periods are not searched by trial over the text: a run of at least four periods has two of them on one side of the boundary,
so only periods up to a quarter of the rule's length for which the words beside the boundary repeat are followed up.

Results: null, empty and blank texts have no words and no runs. Every row is judged by itself, so repeated rows and null ids
get equal results. A very long text is one unit of work with arrays of a few numbers a word. Columns of the input that have
a name of the result are left out.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.llm.chunks import small_batches, without

LEAST_LENGTH, LEAST_PERIODS = 6, 4
WORDS_AT_ONCE, PERIODS_AT_ONCE, LOOKS = 1 << 17, 1 << 20, 16
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUNS_ARROW = pa.list_(pa.struct([pa.field(f.name, pa.int64()) for f in RUN.fields]))
RESULT = ("n_words", "runs", "collapsed")


def words_of(text):
    """Maximal stretches without space, tab, line feed, vertical tab, form feed and carriage return, as bytes."""
    return (text or "").encode("utf-8").split()


class Grammar:
    """Rules of all texts of a batch: symbol `n_terminals + i` derives `left[i]` and `right[i]`."""

    def __init__(self, symbols, docs):
        self.n_terminals = int(symbols.max()) + 1 if len(symbols) else 0
        self.size = np.ones(self.n_terminals, np.int64)
        self.left, self.right, self.at, self.rounds = [], [], [], []
        self.roots, self.root_at = self._fold(*self._compress(symbols.copy(), docs))
        join = (lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64))
        self.left, self.right, self.at = join(self.left), join(self.right), join(self.at)

    def _add(self, left, right, at):
        """New rules and their symbols; `at` is one place of each in the text."""
        first = len(self.size)
        self.left.append(left)
        self.right.append(right)
        self.at.append(at)
        self.size = np.concatenate([self.size, self.size[left] + self.size[right]])
        self.rounds.append((first, len(self.size)))
        return np.arange(first, len(self.size))

    def _compress(self, seq, docs):
        """The sequences that are left when no pair of a text occurs twice, with place and text of each symbol."""
        where = np.arange(len(seq))
        done = []
        while len(seq):
            place, group, count, first = _pairs(seq, docs)
            best = np.zeros(int(docs[-1]) + 1, np.int64)
            np.maximum.at(best, docs[place], count[group])
            open_ = best[docs] >= 2
            if not open_.all():
                done.append((seq[~open_], where[~open_], docs[~open_]))
                seq, where, docs = seq[open_], where[open_], docs[open_]
                continue
            top = 2 * count[group] > best[docs[place]]
            # Ties by a mixed number of the pair: neighbours in the alphabet must not win one after the other.
            mixed = (first.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            rank = np.empty(len(first), np.int64)
            rank[np.argsort(mixed)] = np.arange(len(first))
            weight = np.full(len(seq) + 1, -1, np.int64)
            weight[place + 1] = np.where(top, count[group] * len(first) + rank[group], -1)
            beside = np.append(weight, -1)
            wins = top & (weight[place + 1] > beside[place]) & (weight[place + 1] > beside[place + 2])
            place, group = place[wins], group[wins]
            used = np.bincount(group, minlength=len(first))
            kept = used[group] >= 2
            place, group = place[kept], group[kept]
            groups, lead, of = np.unique(group, return_index=True, return_inverse=True)
            new = self._add(seq[place[lead]], seq[place[lead] + 1], where[place[lead]])
            seq[place] = new[of]
            stay = np.ones(len(seq), bool)
            stay[place + 1] = False
            seq, where, docs = seq[stay], where[stay], docs[stay]
        if not done:
            return seq, where, docs
        seq, where, docs = (np.concatenate(part) for part in zip(*done))
        order = np.argsort(where)
        return seq[order], where[order], docs[order]

    def _fold(self, seq, where, docs):
        """Join neighbours until each text is one symbol; the symbols and their places."""
        while True:
            first = np.searchsorted(docs, docs)
            even = (np.arange(len(docs)) - first) % 2 == 0
            heads = np.flatnonzero(even[:-1] & (docs[1:] == docs[:-1])) if len(docs) else np.zeros(0, np.int64)
            if not len(heads):
                return seq, where
            seq = seq.copy()
            seq[heads] = self._add(seq[heads], seq[heads + 1], where[heads])
            stay = np.ones(len(seq), bool)
            stay[heads + 1] = False
            seq, where, docs = seq[stay], where[stay], docs[stay]

    def places(self, wanted):
        """(rule, place) of every position that the derivation of the texts gives a wanted rule."""
        holds = np.concatenate([np.zeros(self.n_terminals, bool), wanted])
        for low, high in self.rounds:
            own = slice(low - self.n_terminals, high - self.n_terminals)
            holds[low:high] |= holds[self.left[own]] | holds[self.right[own]]
        symbols, at = self.roots[holds[self.roots]], self.root_at[holds[self.roots]]
        found = []
        while len(symbols):
            rule = symbols - self.n_terminals
            own = wanted[rule]
            found.append((rule[own], at[own]))
            left, right = self.left[rule], self.right[rule]
            symbols, at = np.concatenate([left, right]), np.concatenate([at, at + self.size[left]])
            open_ = holds[symbols]
            symbols, at = symbols[open_], at[open_]
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _pairs(seq, docs):
    """Places of neighbours in one text, their pair's number, and count and first place of each pair.

    In a stretch of one symbol every second neighbour counts, as the others overlap it.
    """
    place = np.arange(len(seq) - 1)
    same = docs[1:] == docs[:-1]
    equal = same & (seq[1:] == seq[:-1])
    opens = equal.copy()
    opens[1:] &= ~equal[:-1]
    since = place - np.maximum.accumulate(np.where(opens, place, 0)) if len(place) else place
    place = place[same & (~equal | (since % 2 == 0))]
    key = seq[place] * (int(seq.max()) + 1) + seq[place + 1]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(place), np.int64)
    group[order] = np.cumsum(new) - 1
    return place, group, np.bincount(group, minlength=int(new.sum())), place[order[new]]


def _candidates(x, low, cut, high, side):
    """(rule, period) for which the words on one side of the boundary repeat at that distance, as far as `LOOKS` words."""
    room = (cut - low if side < 0 else high - cut) // 2
    most = np.minimum(room, (high - low) // LEAST_PERIODS)
    most[high - low < LEAST_LENGTH] = 0
    rules = np.flatnonzero(most > 0)
    total = np.cumsum(most[rules])
    begin = 0
    while begin < len(rules):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + PERIODS_AT_ONCE)))
        some = rules[begin:end]
        rule = np.repeat(some, most[some])
        period = np.arange(1, len(rule) + 1) - np.repeat(np.cumsum(most[some]) - most[some], most[some])
        begin = end
        for look in range(LOOKS):
            near = cut[rule] - 1 - look if side < 0 else cut[rule] + look
            far = near - period if side < 0 else near + period
            inside = look < period
            alive = ~inside | (x[np.where(inside, near, 0)] == x[np.where(inside, far, 0)])
            rule, period = rule[alive], period[alive]
        yield rule, period


def _agree(x, i, j, most):
    """How many words from places i and j on are equal, at most `most`."""
    done, block = 0, 32
    while done < most:
        n = min(block, most - done)
        unlike = np.flatnonzero(x[i + done:i + done + n] != x[j + done:j + done + n])
        if len(unlike):
            return done + int(unlike[0])
        done, block = done + n, block * 4
    return done


def _agree_back(x, i, j, most):
    """How many words up to places i and j are equal, at most `most`."""
    done, block = 0, 32
    while done < most:
        n = min(block, most - done)
        unlike = np.flatnonzero(x[i - done - n + 1:i - done + 1] != x[j - done - n + 1:j - done + 1])
        if len(unlike):
            return done + n - 1 - int(unlike[-1])
        done, block = done + n, block * 4
    return done


def crossing_runs(x, low, cut, high):
    """(rule, start, end, period) of the runs within [low, high) that cross `cut`, for each rule; places in the text."""
    sides = [(side, *found) for side in (-1, 1) for found in _candidates(x, low, cut, high, side)]
    if not sides:
        return np.zeros((0, 4), np.int64)
    rule = np.concatenate([r for _, r, _ in sides])
    period = np.concatenate([p for _, _, p in sides])
    side = np.concatenate([np.full(len(r), s) for s, r, _ in sides])
    order = np.lexsort((side, period, rule))
    found, current, own = [], -1, []
    for r, q, s in zip(rule[order].tolist(), period[order].tolist(), side[order].tolist()):
        a, b, e = int(low[r]), int(cut[r]), int(high[r])
        if r != current:
            current, own = r, []
        near, far = (b - q, b) if s < 0 else (b, b + q)
        # A run of a divisor of this period that holds these words is the same run.
        if any(q % p == 0 and start <= near and end >= far for start, end, p in own):
            continue
        back = _agree_back(x, near - 1, far - 1, near - a)
        forth = _agree(x, near, far, e - far)
        start, end = near - back, far + forth
        if start < b < end and end - start >= max(LEAST_LENGTH, LEAST_PERIODS * q):
            own.append((start, end, q))
            found.append((r, start, end, q))
    return np.array(found, np.int64).reshape(-1, 4)


def find_runs(texts):
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    results = [np.zeros((0, 3), np.int64)] * len(texts)
    if starts[-1] == 0:
        return results
    numbers = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(starts[-1]))
    docs = np.repeat(np.arange(len(texts)), sizes)
    symbols = np.unique(docs * len(numbers) + ids, return_inverse=True)[1].astype(np.int64)
    grammar = Grammar(symbols, docs)
    size = grammar.size[grammar.n_terminals:]
    runs = crossing_runs(symbols, grammar.at, grammar.at + grammar.size[grammar.left], grammar.at + size)
    if not len(runs):
        return results
    held = np.bincount(runs[:, 0], minlength=len(size))
    rule, at = grammar.places(held > 0)
    lead = np.concatenate([[0], np.cumsum(held)])  # runs are in the order of their rules
    times = held[rule]
    row = np.repeat(lead[rule], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    shift = np.repeat(at - grammar.at[rule], times)
    start, end, period = runs[row, 1] + shift, runs[row, 2] + shift, runs[row, 3]
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    # Those inside an earlier one of the same period go.
    reach = end + period * (2 * starts[-1])
    alone = np.ones(len(reach), bool)
    alone[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, end, period = start[alone], end[alone], period[alone]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    cuts = np.searchsorted(start, starts)
    for d in np.unique(docs[start]).tolist():
        own = slice(cuts[d], cuts[d + 1])
        results[d] = np.stack([start[own] - starts[d], (end - start)[own], period[own]], axis=1)
    return results


def collapse(words, runs):
    """The words without those after a run's first period, joined by single spaces."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, gone in zip(words, np.cumsum(depth).tolist()) if not gone]
    return b" ".join(words).decode("utf-8")


def with_runs(docs, text_col="text"):
    """`docs` with n_words, runs (start, length, period in words, by start, then period) and the collapsed text."""
    small_batches(docs.sparkSession)
    docs = without(docs, RESULT, {text_col})
    schema = T.StructType([
        *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType())])

    def part(batch, texts):
        found = find_runs(texts)
        lists = [[{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()] for runs in found]
        return pa.RecordBatch.from_arrays([
            *batch.columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(lists, RUNS_ARROW),
            pa.array([collapse(t, r) for t, r in zip(texts, found)], pa.string())],
            names=[f.name for f in schema.fields])

    def add(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            begin, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(words_of(column[i].as_py()))
                size += len(texts[-1])
                if size >= WORDS_AT_ONCE or i + 1 == batch.num_rows:
                    yield part(batch.slice(begin, len(texts)), texts)
                    begin, texts, size = i + 1, [], 0

    return docs.mapInArrow(add, schema)


def planted(doc_id, text):
    """The text with a period planted in every tenth document, told by the checksum of its id; a null id plants none."""
    if text is None or doc_id is None:
        return text
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    words = words_of(text)
    if not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode("utf-8")


def with_planted_periods(docs):
    """(doc_id, text) with the planted texts."""
    small_batches(docs.sparkSession)

    def edit(batches):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([planted(i, t) for i, t in zip(ids, texts)], pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(edit, "doc_id long, text string")


def run_report(found):
    """Counts and digests of the result of `with_runs`: the run of the greatest length / period, all runs, the kept words."""
    # Fractions are compared by cross products; runs come by start, then period, so the first of equals stays.
    top = F.when(F.size("runs") > 0, F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return run_report(with_runs(with_planted_periods(docs)))
