import itertools
import random

import numpy as np
import pytest

from quillon.llm import neardup
from quillon.llm.common import WORD

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, group_id long, norm string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, "x", 5, None) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def brute(texts, p):
    """Components of all pairs that reach the threshold."""
    sets = {i: neardup.shingle_set(t, p.shingle) for i, t in texts.items() if WORD.search(t or "")}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if neardup.jaccard(sets[a], sets[b]) >= p.threshold]
    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return pairs, {i: find(i) for i in sets}


def test_recall_and_precision_against_all_pairs(spark):
    p = neardup.Params()
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs, label = brute(texts, p)
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs, p).collect()}
    assert len(pairs) > 20
    assert [(a, b) for a, b in pairs if got.get(a, -1) != got.get(b, -2)] == []
    for a, b in itertools.combinations(got, 2):  # nothing is grouped that brute force doesn't connect
        if got[a] == got[b]:
            assert label[a] == label[b]


def test_circulant_coordinates_are_shifts_of_one_permutation():
    p = neardup.Params(universe_bits=12)
    c = neardup.Circulant(p)
    d = 1 << 12
    second = c.shifted[:d, 0]
    assert sorted(second) == list(range(d)) and sorted(c.first) == list(range(d))
    shingles = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    at = c.first[shingles >> np.uint64(52)]
    want = [min(second[(x + k) % d] for x in set(at.tolist())) for k in range(p.bands * p.rows)]
    assert c.signature(shingles).tolist() == want


def test_signature_agreement_estimates_jaccard():
    c, rng = neardup.Circulant(neardup.Params()), np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64) * 2
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64) * 2])
    assert abs((c.signature(a) == c.signature(b)).mean() - 0.6) < 0.12


def test_sketches_drop_no_near_copy():
    """Two bits a coordinate, packed, agree as often as the coordinates' own bits do, and nearly always enough at the threshold."""
    p, rng = neardup.Params(), np.random.default_rng(2)
    c, k = neardup.Circulant(p), p.bands * p.rows
    assert 1 - (1 - p.threshold**p.rows) ** p.bands > 0.9 and 0.4 * k < neardup.least_agreement(p) < 0.55 * k
    sigs = []
    for _ in range(300):
        both = rng.integers(0, 2**63, 200).astype(np.uint64) * 2
        sigs += [c.signature(np.concatenate([both, rng.integers(0, 2**63, 100).astype(np.uint64) * 2])) for _ in range(2)]  # similarity 0.5
    sigs = np.stack(sigs)
    bits = neardup.packed_bits(sigs)
    words = bits.shape[1] // 2
    differ = np.bitwise_count(((bits[::2, :words] ^ bits[1::2, :words]) | (bits[::2, words:] ^ bits[1::2, words:])).view(np.uint64)).sum(axis=1)
    assert differ.tolist() == ((sigs[::2] & 3) != (sigs[1::2] & 3)).sum(axis=1).tolist()
    assert (k - differ).min() >= neardup.least_agreement(p)


def test_blocks_of_a_bucket_change_nothing(spark):
    """A text in common puts most documents into the same buckets, in three groups and alone."""
    rng, texts = random.Random(8), []
    hot = [f"h{k}" for k in range(40)]
    for g in range(3):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            own = list(base)
            for k in rng.sample(range(60), 4):
                own[k] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(hot + own))
    texts += [" ".join(hot + [f"o{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(40)]
    rows = lambda p: sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, texts), p).collect())
    _, label = brute(dict(enumerate(texts)), neardup.Params())
    one = rows(neardup.Params())
    assert one == rows(neardup.Params(block=3)) and len({r[1] for r in one}) == 3
    assert all(label[r[0]] == r[1] for r in one) and len(one) == 36


def test_large_group_of_different_copies_is_one_group(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        words = list(base)
        for k in rng.sample(range(200), 6):
            words[k] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = neardup.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == 120 and {r.group_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    a = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", "  \n", "!!!", a, a.upper() + "!", "short", "short", long, long + " end", a]
    df = frame(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None])
    got = {r.doc_id: (r.group_id, r.kept, r.exact) for r in neardup.near_duplicates(df).collect()}
    assert got == {4: (4, True, True), 5: (4, False, True), 6: (6, True, True), 7: (6, False, True), 8: (8, True, False), 9: (8, False, False)}
    left = neardup.one_of_each(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = frame(spark, [a, a, b, b, None], [1, 1, 1, 2, 3])
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1}
    assert sorted((r.doc_id, r.text) for r in neardup.one_of_each(df).collect() if r.text) == [(1, a)]


@pytest.mark.parametrize("texts", [[], ["alone in the world and without any copy"]])
def test_nothing_to_find(spark, texts):
    df = frame(spark, texts)
    assert neardup.near_duplicates(df).collect() == []
    assert neardup.one_of_each(df).count() == len(texts)


def test_columns_with_clashing_names(spark):
    a = "one two three four five six seven"
    df = spark.createDataFrame([(k % 3, a if k < 4 else "x y z", "r", 1, 2) for k in range(6)], "doc_id long, text string, row string, id int, count int")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [0]
