import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = st.sampled_from(list("aeno'sdtl  \n\t\u00a0\x1c\x85éßñ.,!?|1२漢🙂<|>"))


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.codec(raw, public_tokenizers.PATTERN), own, ranks


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_perfect_hash_is_minimal(pair):
    own, _, ranks = pair
    assert None not in own.whole.keys and len(own.whole.keys) == len(ranks)
    assert all(own.whole.get(k) == v for k, v in ranks.items())
    assert own.whole.get(b"no such entry at all") is None
    assert bpe.PerfectHash({}).get(b"x") is None


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=40))
def test_encodes_as_the_library(pair, text):
    own, library, _ = pair
    text = text.encode("utf-8", "ignore").decode()
    raw = own.encode(text)
    assert ids(raw) == library.encode_ordinary(text)
    assert own.decode(raw) == text.encode()


def test_long_pieces_and_batches(pair):
    own, library, _ = pair
    texts = [None, "", " ", "a" * 20_000, "ab " * 9_000, "  x\n\n y", "word, word; it's\nnew line", "\x00a \x00a", "\ufeffÅ\u0308"]
    for text in texts:
        raw = own.encode(text)
        assert ids(raw) == library.encode_ordinary(text or "")


def test_frame(spark, pair):
    _, library, _ = pair
    rows = [(1, "the cat sat", "x"), (1, "the cat sat", "x"), (2, None, None), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = sorted(bpe.digest_frame(df, PATH, public_tokenizers.PATTERN).collect(), key=str)
    assert len(got) == 4
    want = library.encode_ordinary("the cat sat")
    assert [r.n_tokens for r in got if r.doc_id == 1] == [len(want)] * 2
    assert {r.decoded_sha256 for r in got if r.doc_id != 1} == {hashlib.sha256(b"").hexdigest()}
    wide = bpe.encode_frame(df, PATH, public_tokenizers.PATTERN).collect()
    assert [r.token_ids for r in wide if r.doc_id == 1] == [want] * 2
    assert bpe.digest_frame(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
