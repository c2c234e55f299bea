import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import bpe

DATA = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(DATA), special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


def test_documents_as_the_library(codec, tik, spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        own = ids(codec, r.text or "")
        assert own == tik.encode_ordinary(r.text or "")
        assert codec.decode_bytes(own) == (r.text or "").encode()
        assert "".join(codec.decode_stream(own, 3)) == (r.text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehnost éüñß.,!'\n\t1290sdmvlre漢字😀ا", max_size=40))
def test_any_text(codec_text):
    codec, tik = _pair()
    assert ids(codec, codec_text) == tik.encode_ordinary(codec_text)


def _pair(made=[]):  # noqa: B006
    if not made:
        made += [bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(DATA), special_tokens={})]
    return made


def test_random_bytes_of_one_piece(codec):
    plain = bpe.parse_ranks(DATA)
    rng = random.Random(1)
    for _ in range(500):
        piece = bytes(rng.choice(b"thearonis \xc3\xa9\xe4") for _ in range(rng.randrange(1, 24)))
        want = [plain[piece]] if piece in plain else [plain[p] for p in codec.transducer.merge(piece)]
        assert codec.transducer.encode(piece) == want


def test_pieces_run_by_known_transitions(spark):
    """Every byte of every piece that is no token is a step of the transducer, and most steps are known transitions."""
    codec = bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(4000).collect()]
    codec.encode_texts(texts)
    walked = {p.encode() for t in texts for part in codec.parts(t) for p in part} - set(codec.transducer.ranks)
    assert codec.transducer.steps >= sum(map(len, walked)) and codec.transducer.made < 0.35 * codec.transducer.steps


def test_bound_holds_inside_a_piece(tik):
    codec = bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN)
    codec.transducer = bpe.Transducer(codec.transducer.ranks, 1000)
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    assert ids(codec, text) == tik.encode_ordinary(text)
    assert codec.transducer.made > 20_000 and codec.transducer._moves.n <= 1000 and len(codec.transducer._finals) <= 1002


def test_unicode_classes_as_the_library(tik):
    disputed = bpe.disputed_characters(P.PATTERN)
    codec = bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN, disputed)
    for text in ("a\u0558b \u088f1 \U0001e6c0x", "".join(f"a{chr(k)}1{chr(k)}" for k in range(0x500, 0x32000, 7) if not 0xD800 <= k < 0xE000)):
        assert ids(codec, text) == tik.encode_ordinary(text)


def test_latin_pattern(spark):
    import re

    import regex

    plain, latin = regex.compile(P.PATTERN), re.compile(bpe.latin_pattern(P.PATTERN))
    rng = random.Random(8)
    every = [chr(k) for k in range(256)] + list(" '\n\tst") * 20
    for _ in range(3000):
        text = "".join(rng.choices(every, k=rng.randrange(30)))
        assert plain.findall(text) == latin.findall(text)
    assert bpe.latin_pattern(r"\p{Lu}+") is None and bpe.latin_pattern(r"\w+") is None and bpe.latin_pattern(r"[^\s\p{L}]+|\p{N}{1,3}")


def test_parts_of_long_texts(tik, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 64)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    codec = bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN)
    texts = ["", "one two three " * 30, "kurz", "é" * 300, "zwölf Boxkämpfer jagen", "x" * 70 + " yz" * 9]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_texts(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_long_pieces_and_small_memory(tik):
    codec = bpe.Codec(bpe.parse_ranks(DATA), P.PATTERN)
    codec.transducer = bpe.Transducer(codec.transducer.ranks, 50)
    for text in ("a" * 20_000, "ab" * 5000, "=-" * 3000, "ಠ" * 900, "anananananan" * 200):
        assert ids(codec, text) == tik.encode_ordinary(text)


def test_streaming_utf8():
    machine, data = bpe.Utf8Machine(), "aé漢😀b".encode()
    assert "".join([*(machine.feed(data[k : k + 1]) for k in range(len(data))), machine.close()]) == "aé漢😀b"
    for bad in (b"\xc3", b"\xe4\xb8", b"\xf0\x9f\x98", b"\xff", b"\xe0\x80", b"a\xc3("):
        machine = bpe.Utf8Machine()
        got = "".join([*(machine.feed(bad[k : k + 1]) for k in range(len(bad))), machine.close()])
        assert got == bad.decode("utf-8", "replace")


def test_columns(odd, nothing, tik):
    encoded = bpe.encode_texts(odd, DATA, P.PATTERN)
    got = bpe.decode_ids(encoded, DATA, P.PATTERN).join(odd.select("doc_id", "text").distinct(), "doc_id").filter("doc_id <> 4").collect()
    assert all(r.decoded == (r.text or "") and list(r.ids) == tik.encode_ordinary(r.text or "") for r in got)
    assert bpe.encode_texts(odd, DATA, P.PATTERN).count() == odd.count() and bpe.encode_texts(nothing, DATA, P.PATTERN).count() == 0
