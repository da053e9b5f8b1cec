"""Operator 1 against the tiktoken library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import edge_rows, frame

from wayfarer.llm.bpe import Bpe, TextCodec, decoded, encode_decode, encoded, load_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(5)
    mixed = "ab \n\t'se.é全 1\U0001f642\x85\xa0\x1c\x00"
    out = ["", " ", "a  b", "foo  \nbar", "x\x1cy \x1f z", "a" * 4000, "ab" * 2500, "=-" * 900, " " * 300 + "x", "don't I'LL we'll"]
    out += ["".join(rng.choice(mixed) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    return out


def test_same_ids_as_the_library(ranks, library):
    codec = TextCodec(Bpe(ranks), public_tokenizers.PATTERN)
    for text in hard_texts():
        ids, data = codec(text)
        want = library.encode_ordinary(text)
        assert ids[:-1] == ",".join(map(str, want))
        assert codec.encode(text) == want
        assert data == text.encode()


def test_join_is_associative_and_agrees_with_plain_merging(ranks):
    bpe, rng = Bpe(ranks), random.Random(9)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("theinouréñ") for _ in range(rng.randint(1, 25))).encode() for _ in range(3))
        x, y, z = bpe.reduce(a), bpe.reduce(b), bpe.reduce(c)
        assert bpe.join(bpe.join(x, y), z) == bpe.join(x, bpe.join(y, z)) == bpe.merged(a + b + c)


def test_wide_windows_merge_alike(ranks):
    bpe, rng = Bpe(ranks), random.Random(3)
    for _ in range(50):
        data = "".join(rng.choice("thein") for _ in range(60)).encode()
        assert bpe.merged(data) == bpe.reduce(data)


def test_operator_on_edge_rows(spark, library):
    got = encode_decode(frame(spark, edge_rows()), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, text in edge_rows():
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table_and_array_round_trip(spark):
    assert encode_decode(frame(spark, []), PATH, public_tokenizers.PATTERN).collect() == []
    df = decoded(encoded(frame(spark, edge_rows()), PATH, public_tokenizers.PATTERN), PATH)
    for r in df.select("text", "decoded").collect():
        assert (r["text"] is None and r["decoded"] is None) or bytes(r["decoded"]) == r["text"].encode()
