import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe
from tidemark.llm.queries import vocabulary
from tidemark.llm.tokenize import count_tokens, encode_corpus

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(vocabulary())


@pytest.fixture(scope="module")
def reference(merges):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


TEXTS = ["", "a", " ", "   x", "x   ", "\n\n a\r\n", "it's we'll they've I'D 'tis", "<|endoftext|>", "héllo wörld שלום 日本語 😀", "a" * 5000, " " * 3000 + "end", "​﻿\x00", "123456 7,8", "=-" * 900]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("window", [7, 64, 1 << 16])
def test_equals_reference(merges, reference, text, window):
    e = bpe.Encoder(merges, window=window)
    assert e.encode(text) == reference.encode_ordinary(text)
    assert bpe.decode(merges, e.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_any_text_in_any_windows(text, window):
    m = bpe.encoder(vocabulary()).m
    ref = tiktoken.Encoding("own2", pat_str=bpe.PATTERN, mergeable_ranks=m.ranks, special_tokens={})
    assert bpe.Encoder(m, window=window).encode(text) == ref.encode_ordinary(text)


def test_long_pretokens_are_streamed_in_constant_memory(merges, reference):
    rnd = random.Random(3)
    far = bpe.sufficient_lookahead(merges)
    for _ in range(20):
        text = "".join(rnd.choice(["in", "ing", "the", "tion", "e", "é", "ß", "z"]) for _ in range(3000))
        (piece,) = regex.findall(bpe.PATTERN, text)
        t, out, most = bpe.PieceTransducer(merges), [], 0
        raw = piece.encode()
        for k in range(0, len(raw), 50):
            out += t.push(raw[k:k + 50])
            most = max(most, len(t.tail))
        assert out + t.finish() == reference.encode_ordinary(piece)
        assert most <= 6 * merges.longest + far


def test_windows_hold_little_of_a_long_run(merges, reference):
    for text in ("x" * 30_000, " " * 20_000 + "y", "1" * 9_000 + "a", "-=" * 8_000 + " ", "é" * 7_000 + "\n" * 3_000):
        e = bpe.Encoder(merges, window=256)
        parts = list(e.stream(text[k:k + 256] for k in range(0, len(text), 256)))
        assert [i for p in parts for i in p] == reference.encode_ordinary(text)
        assert max(map(len, parts)) < 2_500  # ids leave as they become stable, not all at the end


def test_decoder_gives_text_as_soon_as_it_is_whole(merges):
    ids = bpe.Encoder(merges).encode("日本語")
    machine = bpe.ByteToText(merges)
    assert "".join([machine.push(i) for i in ids] + [machine.finish()]) == "日本語"


def test_corpus_with_nulls_repeats_and_clashing_columns(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello hello", "x"), (3, "hello hello", "x"), (4, " \n ", "x"), (5, "long " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_corpus(df, vocabulary()).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode_corpus(df.limit(0), vocabulary()).count() == 0
    n = count_tokens(df.withColumn("source", df.ids), vocabulary())
    assert {r.doc_id: r.n_tokens for r in n.collect()}[2] == 0
