import itertools

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe

RANKS = bpe.read_vocabulary()
CODEC = bpe.Codec(RANKS)
REAL = tiktoken.Encoding("real", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "a" * 5000, "日本語😀" * 40, "don't we'll  \n\n x", "<|endoftext|>", "²³½ ª 1²a", "\x00\x01￿", "é" * 300, "=" * 999, "İstanbul ßẞ", "‍👩‍👩‍👧"]


@pytest.mark.parametrize("text", ODD)
def test_equals_the_reference_tokenizer_on_odd_texts(text):
    ids = CODEC.encode(text)
    assert ids == REAL.encode_ordinary(text) and CODEC.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_the_reference_tokenizer(text):
    ids = CODEC.encode(text)
    assert ids == REAL.encode_ordinary(text) and CODEC.decode(ids) == text


def test_all_triples_of_controls_and_separators():
    """Every pair of control, space and separator characters, in the narrow and in the wide expression, before and after others."""
    odd = [chr(c) for c in (*range(33), *range(0x7F, 0xA1), 0x1680, 0x2000, 0x2007, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0xFEFF)] + ["a", "1", "é", "'", "-"]
    few = ["\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "\x00", "\t", "a", "1", "!", "\u2028", "日"]
    texts = ["".join(t) for t in itertools.product(odd, repeat=2)] + ["".join(t) for t in itertools.product(few, repeat=3)] + ["".join(t) for t in itertools.product(few[:8], repeat=4)]
    texts.append("\n\n\x1c")
    assert [t for t in texts if CODEC.encode(t) != REAL.encode_ordinary(t)] == []


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120))
def test_fragments_are_independent(raw):
    """A whole piece merged without any cut gives what its fragments give."""
    whole = CODEC._long([raw[k : k + 1] for k in range(len(raw))])
    parts = CODEC.fragments(raw)
    assert b"".join(parts) == raw and sum(map(CODEC.merged, parts), []) == whole


def test_cuts_are_pairs_inside_no_token():
    inside = {(a, b) for t in RANKS for a, b in zip(t, t[1:])}
    assert all(CODEC.joined[a << 8 | b] == ((a, b) in inside) for a in range(256) for b in range(256))


def test_frames(spark):
    df = spark.createDataFrame([(1, "Some text.", 9), (1, "Some text.", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, "wort " * 40_000, 9)], "doc_id long, text string, tokens int")
    out = bpe.encoded_and_decoded(df).collect()
    got = sorted((r.doc_id, r.n_tokens, r.n_bytes, r.round_trip) for r in out)
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and all(g[3] for g in got) and got[2][1:3] == (0, 0)
    assert all(r.tokens == REAL.encode_ordinary("Some text.") for r in out if r.doc_id == 1)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[1] == "Some text." and back[2] == "" and back[4] == "wort " * 40_000
    empty = df.limit(0)
    assert bpe.encoded_and_decoded(empty).count() == 0 and bpe.encode(empty).count() == 0


def test_decoding_refuses_unknown_ids(spark):
    df = spark.createDataFrame([(1, [64]), (2, None), (3, [-1]), (4, [None]), (5, [10**6]), (6, [])], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {1: "a", 2: None, 3: None, 4: None, 5: None, 6: ""}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encoded_and_decoded(docs).collect():
        assert r.round_trip and list(r.tokens) == REAL.encode_ordinary(texts[r.doc_id])
