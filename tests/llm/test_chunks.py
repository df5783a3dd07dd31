import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe, sst
from cairn.llm.bpe import read_vocabulary

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LATIN = st.text(st.sampled_from(list("aeNo'sdt  \n\n\t\r\x0b\x1céÉß×÷Ȁ.,!?|1-\"")), max_size=40)
ANY = st.text(st.sampled_from(list("ae's \n. \u0085ɐ漢🙂é|<>,")) | st.characters(exclude_categories=["Cs"]), max_size=20)
TEXTS = st.lists(st.none() | LATIN | ANY | st.just("<|endoftext|>") | st.just(""), max_size=8)


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(read_vocabulary(None, RANKS), public_tokenizers.PATTERN)
    ranks = {k: v for k, v in zip(own.pieces, range(len(own.pieces)), strict=True) if k}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [
        (own.encoder.encode_many, library.encode_ordinary),
        (sst.library_encoder(read_vocabulary(None, VOCABULARY)).encode_many, lambda t: tokenizer.encode(t, add_special_tokens=False).ids),
    ]


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_batches_equal_the_libraries(both, texts):
    column = pa.array(["sliced off", *texts], pa.string())[1:]
    for many, library in both:
        ids, bounds = many(column)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library(t or "") for t in texts]
        assert len(bounds) == len(texts) + 1 and (len(ids) == bounds[-1])
