"""Substring, suffix and SimHash dedup beside brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import as_dict, documents, odd_texts
from pyspark.sql import functions as F

from policylens.llm import chunks, components, rolling, simhash_dedup, substring_dedup, suffix_dedup
from policylens.sources.staging import stage


def slow_substrings(texts, window=13):
    seen, out = {}, {}
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            run = tuple(w[k:k + window])
            if seen.setdefault(run, i) < i:
                gone[k:k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x.decode() for x, g in zip(w, gone) if not g))
    return out


def slow_suffixes(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 3000])
def test_substring_dedup(odd, chunk_bytes):
    result = as_dict(substring_dedup.remove_repeats(odd, chunk_bytes=chunk_bytes), "key")
    for i, expected in slow_substrings(odd_texts()).items():
        r = result[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == expected


def test_substring_dedup_keeps_rows_and_columns(odd, strange, empty):
    out = substring_dedup.dedup_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert substring_dedup.substring_dedup(strange).count() == strange.count()
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert substring_dedup.dedup_documents(empty).count() == 0
    rows = substring_dedup.substring_dedup(strange).collect()
    # Rows of one id, and rows without an id beside none with one, do not remove each other's words.
    by_id = Counter(r["doc_id"] for r in rows)
    assert by_id[None] > 1
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(empty, window=12)


def test_cover_aligns_any_two_places():
    cover = set(substring_dedup.COVER)
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in cover and (j + d) % 7 in cover for d in range(7))


@pytest.mark.parametrize("crowd,chunk_bytes", [(2000, 1 << 22), (2000, 3000), (1, 3000)])
def test_suffix_dedup(odd, crowd, chunk_bytes):
    texts = odd_texts()
    result = as_dict(suffix_dedup.suffix_dedup(odd, crowd=crowd, chunk_bytes=chunk_bytes))
    for i, expected in slow_suffixes(texts, 400).items():
        r = result[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == expected
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_suffix_dedup_of_odd_tables(spark, strange, empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(strange).count() == strange.count()
    texts = ["abcabcabcabc" * 5, "xyz" + "abcabcabcabc" * 3 + "q", "nothing here", None, "no" * 30]
    result = as_dict(suffix_dedup.suffix_dedup(documents(spark, texts), length=20, anchor=9))
    for i, expected in slow_suffixes(texts, 20).items():
        assert (result[i]["n_bytes"], result[i]["n_removed"], len(result[i]["spans"]), bytes(result[i]["kept"])) == expected


def test_merging_finds_repeated_strings_only():
    rng = np.random.default_rng(0)
    length, anchor = 30, 10
    middle = rng.integers(97, 100, anchor, dtype=np.uint8).tobytes()
    spans = []
    for _ in range(60):
        left, right = (rng.integers(97, 99, 12, dtype=np.uint8).tobytes() for _ in range(2))
        spans.append(left[:12] + middle + right)
    # Strings that hold the anchor at distance 8 down to 4.
    shards = [
        (np.full(20, 7, np.uint64), np.full(20, 5, np.uint16), np.full(20, 12, np.uint16), b"".join(spans[i:i + 20]))
        for i in (0, 20, 40)]
    found = np.concatenate(suffix_dedup.merge_shards(shards, length, anchor))
    strings = [s[o:o + length] for s in spans for o in range(5)]
    groups = Counter((s, o % 5) for o, s in zip(range(len(strings)), strings))
    assert found.tolist() == [groups[s, o % 5] > 1 for o, s in zip(range(len(strings)), strings)]


def slow_print(text, shingle=4):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[k:k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum((c * 2 > len(parts)) << b for b, c in enumerate(counts))


def slow_components(prints, ids, distance=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for i, x in zip(ids, label):
        if i is not None:
            first[x] = min(first.get(x, i), i)
    return [first.get(x) for x in label]


def test_simhash_near_duplicates(odd):
    texts = odd_texts()
    prints = [slow_print(t) for t in texts]
    expected = slow_components(prints, range(len(texts)))
    result = as_dict(simhash_dedup.near_duplicates(odd))
    for i, (p, c) in enumerate(zip(prints, expected)):
        assert result[i]["fp"] & (1 << 64) - 1 == p and result[i]["component_id"] == c
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_simhash_of_odd_tables(strange, empty):
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.keep_one(empty).count() == 0
    rows = strange.collect()
    expected = slow_components([slow_print(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    got = simhash_dedup.near_duplicates(strange).collect()
    assert Counter(r["component_id"] for r in got) == Counter(expected)


def test_keeping_one_stores_a_row_per_fingerprint(spark, odd, monkeypatch):
    stored = {}

    def counted(df, label):
        table = stage(df, label)
        stored[label] = table.count()
        return table

    monkeypatch.setattr(simhash_dedup, "stage", counted)
    docs = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    prints = [slow_print(t) for t in odd_texts()]
    kept = simhash_dedup.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(slow_components(prints, range(len(prints)))))
    assert stored and max(stored.values()) <= len(set(prints)) < docs.count()


@pytest.mark.parametrize("parts,limit", [(5, 1000), (6, 1000), (8, 1000), (6, 3)])
def test_links_keep_every_component(spark, parts, limit):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(seeds.tolist())
    for seed in seeds.tolist():
        at = seed
        for _ in range(12):  # a chain: neighbours are within 4 bits, its ends are not
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                at ^= 1 << bit
            prints.add(at)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = components.connected(simhash_dedup.links(df, parts=parts, group_limit=limit)).collect()
    label = {r["node"] & (1 << 64) - 1: r["component"] for r in found}
    expected = slow_components(prints, prints)
    groups = Counter(expected)
    assert {p for p, c in zip(prints, expected) if groups[c] > 1} == set(label)
    pairs = {(c, label[p]) for p, c in zip(prints, expected) if p in label}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_pivot_distances_never_discard_a_near_pair():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    table = [simhash_dedup.pivot_table(x, simhash_dedup.pivots()) for x in (a, b)]
    assert np.abs(table[0] - table[1]).max() <= 4
    assert len(simhash_dedup.forest(np.concatenate([a[:3], b[:3]]), np.zeros(6, int), 4, simhash_dedup.pivots())) == 3


def test_parts_grow_with_the_number_of_fingerprints():
    chosen = [simhash_dedup.parts_for(n, 4) for n in (0, 10**5, 10**8, 10**10, 10**15)]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[-1] == 10


def test_rolling_hashes_are_of_content():
    data = np.frombuffer(b"some words and some words again, some words", np.uint8)
    sums = rolling.FIRST.prefix(data)
    at = [0, 15, 33]
    assert len(set(rolling.FIRST.stretches(sums, np.array(at), np.array(at) + 10).tolist())) == 1
    starts, ends, (one, _) = rolling.word_hashes(data)
    names = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert names == data.tobytes().split()
    assert len(set(zip(names, one.tolist()))) == len(set(names))


def test_chunk_bodies_cover_all_keys():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    cuts = chunks.bucket_cuts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == 1000 and (np.diff(cuts) > 0).all()
    assert (chunks.from_planes(chunks.planes(keys), 1000) == keys).all()


def test_kept_digest_is_of_kept_words(spark, tmp_path):
    texts = odd_texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for i, (n, gone, kept) in slow_substrings(texts).items():
        if i == 0:
            result = as_dict(substring_dedup.op3_substring_dedup(spark, str(tmp_path)))
        assert result[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert (result[i]["n_words"], result[i]["n_removed"]) == (n, gone)
