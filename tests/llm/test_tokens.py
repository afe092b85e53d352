"""Token counts and packing beside the library."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import as_dict, documents, odd_texts
from tokenizers import Tokenizer

from policylens.llm import packing, token_counts

PIECES = [
    "a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'S", "'", "!", "1", "23", "é", "É", "ß", "ñ", "漢", " ", "　", "́", "²", "Ⅷ",
    "<|endoftext|>", "<|startoftext|>", "<|end", "hello", "THE", "\x1c", "\x85", "\xa0", "🙂", "_", "-", "ª", "µ", "×", "İ", "ς",
    "'ve", "r", "e", "l", "v", "s", "\x00", "~"]


def made_up(n, longest=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_equal_the_library():
    texts = made_up(4000) + ["a" * 3000, "=-" * 2000, " " * 2000, "\n" * 99 + "x", "aaab" * 500, "don't 'tis it's'"]
    ours = token_counts.compiled(token_counts.VOCABULARY).counts(texts)
    theirs = [len(e.ids) for e in library(token_counts.VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert ours == theirs


def test_counts_survive_forgetting():
    texts = made_up(300, seed=2)
    small = token_counts.Compiled(public_tokenizers.path(token_counts.VOCABULARY), keep=50)
    assert small.counts(texts) == token_counts.compiled(token_counts.VOCABULARY).counts(texts)
    assert len(small.memory.count.__self__.contents) < 2000


def test_state_maps_compose():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    running = token_counts.compose(maps)
    state = np.arange(8)
    for i, step in enumerate(maps):
        state = step[state]
        assert (running[i] == state).all()


def test_stretches_give_the_pre_tokens_of_the_library():
    tokenizer = library(token_counts.VOCABULARY)
    splitter = token_counts.compiled(token_counts.VOCABULARY).splitter
    for text in made_up(300, longest=200, seed=4):
        text = text.replace("<|endoftext|>", "")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(splitter.begin(codes)) if len(codes) else []
        assert list(begins) == [span[0] for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_token_counts_of_odd_tables(odd, empty, strange):
    texts = [t or "" for t in odd_texts()]
    theirs = [len(e.ids) for e in library(token_counts.VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    result = as_dict(token_counts.token_counts(odd))
    for i, n in enumerate(theirs):
        assert result[i]["n_tokens"] == n and result[i]["n_bytes"] == len(texts[i].encode())
    assert token_counts.token_counts(empty).count() == 0
    assert token_counts.token_counts(strange).count() == strange.count()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Compiled(public_tokenizers.path(packing.VOCABULARY))


def test_ids_equal_the_library():
    texts = made_up(4000, seed=5)
    theirs = [e.ids for e in library(packing.VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    words = packing.Words(public_tokenizers.path(packing.VOCABULARY), keep=200)
    ours = [ids.tolist() for at in range(0, len(texts), 100) for ids in words.encode(texts[at:at + 100])]
    assert ours == theirs


def test_parts_are_encoded_once_whatever_word_they_stand_in():
    words = packing.Words(public_tokenizers.path(packing.VOCABULARY))
    texts = ["Alpha, alpha. (ALPHA)", "alpha's\talpha-alpha;\nÉté été", "ＡLPHA alpha, <|endoftext|>alpha café", "x\u00a0y alpha\x0b'll"]
    theirs = [e.ids for e in library(packing.VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in words.encode(texts)] == theirs
    assert set(words.number) == {
        "alpha", ",", ".", "(", ")", "'s", "-", ";", "été", "'ll", "café", " ＡLPHA", " <|endoftext|>alpha", " x\u00a0y"}


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("partition_rows", [50_000, 3])
def test_packing_of_odd_tables(odd, empty, strange, partition_rows):
    texts = [t or "" for t in odd_texts()]
    tokenizer = library(packing.VOCABULARY)
    expected = set()
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        ids = [*e.ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected.add((i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    placed, bins, bound = packing.pack_pieces(packing.pieces_of(odd), partition_rows=partition_rows)
    assert {tuple(r[c] for c in packing.PIECE.names) for r in placed.collect()} == expected
    assert bins >= bound
    if partition_rows > 3:
        rows = packing.pack_documents(odd).collect()
        assert len(rows) == len(expected) and bound <= check_packing(rows, 2048) == bins <= bound + 1
        assert packing.pack_documents(empty).count() == 0
        assert packing.pack_documents(strange).count() == strange.count()


def test_rounds_exchange_documents(spark):
    rng = random.Random(7)
    pieces = spark.createDataFrame(
        [(i, 0, 0, rng.choice([90, 120, 333, 700, 1100, 2048]), 0) for i in range(600)], packing.PIECE)
    placed, bins, bound = packing.pack_pieces(pieces, partition_rows=40)
    rows = [r.asDict() for r in placed.collect()]
    for r in rows:
        r["sequence_id"] = (r["round"], r["part"], r["bin"])
    assert len({r["key"] for r in rows}) == len(rows) == 600
    assert len({r["round"] for r in rows}) > 1
    assert check_packing(rows, 2048) == bins
    assert bound <= bins <= 1.02 * bound + 1


def test_lower_bound_is_never_above_the_best_packing():
    rng = random.Random(0)
    for _ in range(40):
        lengths = np.array([rng.randint(1, 20) for _ in range(8)])
        bound = packing.lower_bound(*np.unique(lengths, return_counts=True), 20)
        assert bound <= fewest(lengths.tolist(), 20)
    assert packing.lower_bound([11], [5], 20) == 5  # the volume alone would say 3
    assert packing.lower_bound([7], [6], 20) == 3
    assert packing.lower_bound([], [], 20) == 0


def fewest(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit_decreasing(np.array([3, 6, 5, 4, 2]), 10)
    assert bins.tolist() == [1, 0, 1, 0, 1] and offsets.tolist() == [5, 0, 0, 6, 8]


def test_documents_that_are_longer_are_cut(spark):
    rows = as_dict(packing.pack_documents(documents(spark, ["a " * 5000])), "piece")
    assert [rows[i]["length"] for i in range(3)] == [2048, 2048, 905]
    assert [rows[i]["start"] for i in range(3)] == [0, 2048, 4096]


def test_one_id_fills_no_partition(spark):
    """Rows without an id, all alike, are dealt to many partitions; the best round is kept."""
    rng = random.Random(8)
    rows = [(None, 0, 0, 700, 5)] * 400 + [(i, 0, 0, rng.randrange(450, 900), 0) for i in range(800)]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    placed, bins, bound = packing.pack_pieces(pieces, partition_rows=60)
    kept = placed.collect()
    assert len(kept) == len(rows) and len({(r["round"], r["part"], r["bin"]) for r in kept}) == bins >= bound
    assert max(Counter((r["round"], r["part"]) for r in kept).values()) <= 2 * (60 << packing.LARGEST)
    one = len(set(packing.best_fit_decreasing(np.array([r[3] for r in rows]), 2048)[0].tolist()))
    assert bins <= one * 1.02
