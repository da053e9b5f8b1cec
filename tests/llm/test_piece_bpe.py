"""Operator 12 against the sentencepiece library, spans included."""

import hashlib
import os
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from helpers import edge_rows, frame

from wayfarer.llm.piece_bpe import Normalizer, PieceModel, encode_decode_pieces, units_of
from wayfarer.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF0001 = "/root/testdata/sf0.001"


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_rules(path, folder, rule, squeeze):
    """The model with another normaliser (the file's last one counts)."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    spec += b"\x18\x01" + b"\x20" + bytes([squeeze]) + b"\x28\x01"
    name = os.path.join(folder, f"{rule}-{squeeze}.model")
    with open(path, "rb") as f, open(name, "wb") as g:
        g.write(f.read() + b"\x1a" + varint(len(spec)) + spec)
    return name


def hard_texts():
    rng = random.Random(4)
    mixed = "ab  \n\t▁.é全　1ﬁ①ｶﾞ½\U0001f980▅\x00\xa0​각"
    out = ["", " ", "   ", "▁", "▁▁ a", "<s></s><unk><0x41>", "a" * 3000, "全" * 500, "\x00", "\U0001f980" * 9, "  two  words  "]
    out += ["".join(rng.choice(mixed) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    return out


def same(model, library, text):
    ids, starts, ends = model.encode(text)
    ids = ids.tolist()
    assert ids == library.encode(text)
    assert model.decode([*ids, 2]) == library.decode([*ids, 2])
    want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
    assert list(zip(starts.tolist(), ends.tolist())) == want


def test_ids_spans_and_decoding_equal_the_library():
    model, library = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in hard_texts():
        same(model, library, text)
    for text in pq.read_table(f"{SF0001}/documents.parquet").column("text").to_pylist():
        same(model, library, text or "")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_compiled_character_maps(tmp_dir, rule, squeeze):
    path = with_rules(PATH, tmp_dir, rule, squeeze)
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in hard_texts():
        same(model, library, text)


def test_long_units_merge_alike():
    model, rng = PieceModel(PATH), random.Random(2)
    for _ in range(100):
        unit = "▁" + "".join(rng.choice("theinou") for _ in range(rng.randint(1, 47)))
        assert tuple(model.id_of[p] for p in model._merged_long(unit)) == model.merged(unit)


def test_letters_are_merged_apart_from_what_stands_beside_them():
    model, library = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(7)
    mixed = "aeé²½.1_▁ \n-$中ßºª٣Ⅷñ"
    for text in ["".join(rng.choice(mixed) for _ in range(rng.randint(0, 40))) for _ in range(2000)]:
        assert "".join(model.units_of(text)) == text
        same(model, library, text)
    model.encode("word, word. word\nword word!?")
    assert [u for u in model.units if "word" in u] == ["▁word", "word"]


def test_units_stay_whole_where_a_piece_crosses():
    assert units_of(["ab", "▁a", ".", "²."])("▁ab.c²ab▁▁") == ["▁ab", ".", "c", "²", "ab", "▁▁"]
    assert units_of(["ab", "b."])("▁ab.c▁d") == ["▁ab.c", "▁d"]
    assert units_of(["a▁b"])("▁ab.c▁d") == ["▁ab.c▁d"]


def test_alignment_covers_the_text():
    normalizer = Normalizer(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    for text in hard_texts():
        out, align = normalizer(text)
        assert len(align) == len(out) + 1 and (align[1:] >= align[:-1]).all() and align[-1] <= len(text.encode())


def test_decoding_any_ids():
    model, library = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 13, 259, 28705, 264, rng.randrange(3, 32000)]) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if not 131 <= i <= 258]  # broken byte sequences are not defined
        assert model.decode(ids) == library.decode(ids), ids


def test_other_models_are_refused(tmp_dir):
    path = os.path.join(tmp_dir, "unigram.model")
    with open(PATH, "rb") as f, open(path, "wb") as g:
        g.write(f.read() + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        PieceModel(path)


def test_operator_on_edge_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = encode_decode_pieces(frame(spark, edge_rows()), PATH).collect()
    found = sorted(((r["doc_id"], r["token_ids"], r["decoded"]) for r in got), key=repr)
    want = []
    for i, text in edge_rows():
        ids = library.encode(text or "", add_eos=True)
        want.append((i, ids, library.decode(ids)))
    assert found == sorted(want, key=repr)
    for r in got:
        assert len(r["starts"]) == len(r["ends"]) == len(r["token_ids"]) and r["starts"][-1] == r["ends"][-1]


def test_empty_table(spark):
    assert encode_decode_pieces(frame(spark, []), PATH).collect() == []


def test_query_equals_the_library_on_the_whole_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = QUERIES["op12_piece_bpe"](spark, SF0001)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
