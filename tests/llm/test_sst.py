import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import sst
from cairn.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, k string"


def brute(rows, end=2):
    own, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    words = ["the cat", "sat, on it", "", None, "  x\n\ny ", "été <|endoftext|> z", "a" * 5000]
    rows = [(i * 7 - 50, words[i % 7], "x") for i in range(200)] + [(None, "n", None), (6, "twice", "x"), (6, "twice", "x"), (-(2**63), "low", ""), (2**63 - 1, "high", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sst.round_trip(df, PATH, 2).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
    assert sst.round_trip(df.limit(0), PATH, 2).count() == 0


def test_lookup(spark):
    rows = [(i * 3, f"doc {i} " + "text " * 800, "") for i in range(2000)] + [(9, "again", "")]
    path = scratch_path(spark, "sst")
    sst.write_shards(spark.createDataFrame(rows, SCHEMA), path, PATH, 2)
    own = Tokenizer.from_file(PATH)
    opened = []
    got = sst.lookup(spark, path, [9, 10, 600, None, -5, 10**15], opened)
    assert all(f.bytes_read < f.length / 2 for f in opened) and len(opened) > 1
    assert sst.lookup(spark, path, []) == []
    assert sorted(map(str, got)) == sorted(str((d, [*own.encode(t).ids, 2])) for d, t, _ in rows if d in (9, 600))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aeno'sd  \n\t \x1c\x85é.,!|1२漢🙂")), max_size=60) | st.text(max_size=30))
def test_encodes_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    with open(PATH, "rb") as f:
        raw = f.read()
    want = OWN.encode(text, add_special_tokens=False).ids
    got = sst.library_encoder(raw).encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
