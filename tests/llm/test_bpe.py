import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from furlong.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "hello world", "Ünïcode  \n\n tabs\t\x1c\x85 x's 12345", "a" * 5000, "日本語テキスト 🙂🙂", " " * 300, "thonblewhat " * 500, "</s>[INST] ok"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(codec, own):
    for t in TEXTS:
        assert codec.encode(t) == own.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    c = _one()
    assert c.encode(text) == _lib().encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()


_kept = {}


def _one():
    if "c" not in _kept:
        _kept["c"] = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    return _kept["c"]


def _lib():
    if "l" not in _kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        _kept["l"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _kept["l"]


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.slots) == codec.known
    assert all(codec.whole(codec.tokens[i]) == i for i in codec.known)
    assert codec.whole(b"not a token at all") is None


def test_rows(spark, own):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (1, "hello world", "z")], "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = "" if r.doc_id is None else TEXTS[r.doc_id]
        ids = own.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
