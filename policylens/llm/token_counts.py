"""Token counts by a compiled finite-state tokenizer.

Method: byte-level BPE is compiled into two deterministic transducers.

The splitter reads classes of characters, each with the look-ahead its rules need, and marks where a pre-token begins. Its
states are few, so a stretch of text is a map from entry state to exit state. The maps of all stretches are computed side by
side, composed by a parallel prefix scan, and the marks are then read off with every entry state known.

The counter reads the bytes of a pre-token. Its transitions are annotated with the change in the number of tokens, and are
compiled when first needed: a state holds, for each place from which a vocabulary entry could still be running, the last
token of the encoding up to there and its count. The encoding of a prefix ends in the only entry that may follow the
encoding before it, and entries may follow each other if merging their bytes gives just these two.

Special strings of the vocabulary file are one token each and split the text, as in the library. Null texts are empty and
have no tokens. Texts are never cut; the compiled states and the counts of pre-tokens a worker keeps are dropped and built
anew beyond `keep` entries, which changes no count.
"""

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from policylens.llm.chunks import small_batches, without

VOCABULARY, LIMIT, STRETCH, KEEP = "byte_bpe_50k.json", 512, 64, 400_000
BREAK_CODE = 0x110000
FRESH, LETTERS, DIGITS, OTHERS, BLANKS, PENDING, ONE_MORE, TWO_MORE = range(8)
# Classes: a break between texts; the last blank before a visible character, a space or another; any other blank; letter;
# digit; other; an apostrophe that with the next one or two letters is a contraction.
BREAK, LAST_SPACE, LAST_BLANK, BLANK, LETTER, DIGIT, OTHER, SHORT, LONG = range(9)
# Contractions of the splitting pattern, fixed by the vocabulary file's library: one letter, or two, after an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def splitter():
    """(next state, does a pre-token begin here) by state and class."""
    to = np.zeros((8, 9), dtype=np.uint8)
    begins = np.zeros((8, 9), dtype=bool)
    for state in range(8):
        def rule(kind, target, begin):
            to[state, kind], begins[state, kind] = target, begin
        rule(BREAK, FRESH, False)
        rule(LAST_SPACE, PENDING, True)
        rule(LAST_BLANK, BLANKS, True)
        rule(BLANK, BLANKS, state != BLANKS)
        for kind, run in ((LETTER, LETTERS), (DIGIT, DIGITS), (OTHER, OTHERS)):
            rule(kind, run, state not in (run, PENDING))
        for kind, rest in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            joins = state in (OTHERS, PENDING)
            rule(kind, OTHERS if joins else rest, not joins)
    for kind in range(1, 9):
        to[ONE_MORE, kind], begins[ONE_MORE, kind] = FRESH, False
        to[TWO_MORE, kind], begins[TWO_MORE, kind] = ONE_MORE, False
    return to, begins


def compose(maps):
    """Running composition of state maps, one row each: row i takes a state through maps 0 to i."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


class Splitter:
    def __init__(self, probe):
        """`probe(text)`: the library's pre-tokens, asked once for each character beyond ASCII."""
        self.probe = probe
        self.to, self.begins = splitter()
        self.kinds = np.full(BREAK_CODE + 1, 255, dtype=np.uint8)
        self.kinds[BREAK_CODE] = BREAK
        for code in range(128):
            c = chr(code)
            self.kinds[code] = BLANK if c in " \t\n\r\v\f" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER

    def _classes(self, codes):
        kinds = self.kinds[codes]
        for code in np.unique(codes[kinds == 255]).tolist():
            c = chr(code)
            self.kinds[code] = next((kind for first, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER))
                                     if len(self.probe(first + c)) == 1), BLANK)
        kinds = self.kinds[codes]
        following = np.append(kinds[1:], BREAK)
        last = (kinds == BLANK) & (following != BLANK) & (following != BREAK)
        kinds[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_BLANK)
        for i in np.flatnonzero(codes == 39).tolist():
            after = "".join(chr(c) for c in codes[i + 1:i + 3].tolist() if c < BREAK_CODE)
            if after[:1] and after[0] in ONE_LETTER and codes[i + 1] < BREAK_CODE:
                kinds[i] = SHORT
            elif after in TWO_LETTERS and codes[i + 1] < BREAK_CODE:
                kinds[i] = LONG
        return kinds

    def begin(self, codes):
        """Where pre-tokens begin in texts laid one behind the other with a break between."""
        n = len(codes)
        kinds = np.full(-(-n // STRETCH) * STRETCH, BREAK, dtype=np.intp)
        kinds[:n] = self._classes(codes)
        kinds = np.ascontiguousarray(kinds.reshape(-1, STRETCH).T)
        to = self.to.astype(np.intp).reshape(-1)
        maps = np.tile(np.arange(8, dtype=np.intp), (kinds.shape[1], 1))
        for step in kinds:
            maps = to[maps * 9 + step[:, None]]
        after = compose(maps.astype(np.uint8))[:, FRESH]
        state = np.concatenate(([FRESH], after[:-1])).astype(np.intp)
        begins, flat = np.empty(kinds.shape, dtype=bool), self.begins.reshape(-1)
        for i, step in enumerate(kinds):
            at = state * 9 + step
            begins[i] = flat[at]
            state = to[at]
        return begins.T.reshape(-1)[:n]


def byte_alphabet():
    """The character that stands for each byte in the vocabulary: itself if it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """The lazily compiled transducer from bytes to token counts. Vocabulary entries are numbers in it."""

    def __init__(self, vocabulary, merges, keep=KEEP):
        letters = byte_alphabet()
        spelled = sorted(bytes(letters[c] for c in t) for t in vocabulary if all(c in letters for c in t))
        self.number = {t: i for i, t in enumerate(spelled)}
        self.ranks, self.made, self.joined = {}, {}, {}
        for rank, (left, right) in enumerate(merges):
            pair = tuple(self.number[bytes(letters[c] for c in side)] for side in (left, right))
            self.ranks[pair] = rank
            self.joined[pair] = self.number[spelled[pair[0]] + spelled[pair[1]]]
            self.made.setdefault(self.joined[pair], (rank, *pair))
        # Bytes that an entry could go on from.
        self.open = {t[:i] for t in spelled for i in range(len(t))}
        self.number = {t: i for t, i in self.number.items() if self.merge(t) == [i]}
        self.keep, self.pairs = keep, {}
        self._reset()

    def _reset(self):
        # A state: the bytes an entry may have begun with, and (last entry, count) at each place of them from which one
        # may be running, counts taken from the last place.
        start = (b"", ((None, 0),))
        self.states, self.contents, self.moves = {start: 0}, [start], [{}]

    def merge(self, text):
        """Entries of a text by merging pairs in the order of their ranks."""
        parts = [self.number[text[i:i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [self.joined[parts[i], parts[i + 1]]]
        return parts

    def _follows(self, before, entry):
        """Would merging leave both as they are, side by side?

        Looks back in time at what stood at the border, the later of the two merges undone first: the pair there must not
        have been due before either side was merged on. Of equal ranks the left one is merged first.
        """
        left, right = before, entry
        left_ends = right_ends = 1 << 60
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and rank < left_ends and rank <= right_ends:
                return False
            one, two = self.made.get(left), self.made.get(right)
            if one is None and two is None:
                return True
            if two is None or one is not None and one[0] > two[0]:
                left_ends, left = one[0], one[2]
            else:
                right_ends, right = two[0], two[1]

    def _may_follow(self, before, entry):
        if before is None:
            return True
        found = self.pairs.get((before, entry))
        if found is None:
            if len(self.pairs) > self.keep:
                self.pairs.clear()
            found = self.pairs[before, entry] = self._follows(before, entry)
        return found

    def _compile(self, state, byte):
        running, places = self.contents[state]
        running += bytes((byte,))
        for k, place in enumerate(places):
            last = self.number.get(running[k:]) if place else None
            if last is not None and self._may_follow(place[0], last):
                count = place[1] + 1
                break
        places = (*places, (last, count))
        drop = 0
        while running[drop:] not in self.open:
            drop += 1
        content = running[drop:], tuple(
            (p[0], p[1] - count) if p and running[k:] in self.open else None for k, p in enumerate(places[drop:], drop))
        target = self.states.get(content)
        if target is None:
            target = self.states[content] = len(self.contents)
            self.contents.append(content)
            self.moves.append({})
        move = self.moves[state][byte] = (target, count)
        return move

    def count(self, data):
        if len(self.contents) > self.keep:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for byte in data:
            move = moves[state].get(byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return total


class Memory(dict):
    """Counts of pre-tokens."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, text):
        found = self[text] = self.count(text.encode("utf-8"))
        return found


class Compiled:
    """Both transducers of a vocabulary file."""

    def __init__(self, path, keep=KEEP):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            facts = json.load(file)
        model, before = facts["model"], facts["pre_tokenizer"]
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"}
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or before["type"] != "ByteLevel" \
                or before["add_prefix_space"] or not before["use_regex"] or facts["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = sorted((t["content"] for t in facts["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.memory = Memory(Counter(set(model["vocab"]) - set(special), merges, keep).count)
        self.keep = keep

    def counts(self, texts):
        """Number of tokens of each text."""
        totals, owners, parts = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            totals[i] = len(pieces) - 1
            for piece in pieces:
                if piece:
                    owners.append(i)
                    parts.append(piece)
        if not parts:
            return totals
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        offsets = np.cumsum(lengths + 1) - lengths - 1
        codes = np.full(int(lengths.sum()) + len(parts), BREAK_CODE, dtype=np.uint32)
        for offset, part in zip(offsets.tolist(), parts):
            codes[offset:offset + len(part)] = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(self.splitter.begin(codes))
        cuts = np.append(np.searchsorted(begins, offsets), len(begins))
        known = self.memory
        for k, (owner, part) in enumerate(zip(owners, parts)):
            places = (begins[cuts[k]:cuts[k + 1]] - offsets[k]).tolist()
            totals[owner] += sum([known[part[a:b]] for a, b in zip(places, [*places[1:], len(part)])])
            if len(known) > self.keep:
                known.clear()
        return totals


_compiled = {}


def compiled(vocabulary):
    """The transducers of a vocabulary, once per worker; a name without a slash is one of the public files."""
    if vocabulary not in _compiled:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _compiled[vocabulary] = Compiled(path)
    return _compiled[vocabulary]


def token_counts(docs, text_col="text", vocabulary=VOCABULARY):
    """`docs` with n_bytes (UTF-8) and n_tokens of each whole text; columns of these names are replaced."""
    docs = without(docs, RESULT.names, [text_col])
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    arrow_schema = to_arrow_schema(schema)

    def add(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            sizes = [len(t.encode("utf-8")) for t in texts]
            counts, at = [], 0
            while at < len(texts):  # a few million characters at once
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= 1 << 20:
                    size += len(texts[to])
                    to += 1
                counts += compiled(vocabulary).counts(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=arrow_schema)

    return docs.mapInArrow(add, schema)


def op5_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
