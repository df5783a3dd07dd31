import gzip
import hashlib

from cairn.llm import warc
from cairn.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    out = []
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        top = max((q for q, _, g, *_ in rows if (g or "").encode() == raw and q is not None), default=None)
        to = top if len(raw) >= 1000 and top is not None and top != p else None
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def sample():
    big = "é<p>same</p>\r\n\r\n" * 200
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>" * (i % 90), "x") for i in range(120)]
    rows += [(200 + i, None if i % 2 else "http://h/a b\n", big, None) for i in range(5)]
    return rows + [(204, "u", big, ""), (None, "u", big, ""), (None, None, None, None), (300, "u", "", ""), (301, "u", "x" * 999, ""), (302, "u", "x" * 999, ""), (303, "u", "WARC/1.1\r\n" * 100, "")]


def test_round_trip(spark):
    df = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(sample())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_normalised_members_and_index(spark):
    df = spark.createDataFrame(sample(), SCHEMA).repartition(2)
    raw, path = scratch_path(spark, "w"), scratch_path(spark, "w")
    warc.write_archives(warc.mark_revisits(df), raw)
    warc.normalise(spark, raw, path)
    files = {r.archive: bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("kind = 'warc'").collect()}
    index = warc.read_index(spark, path).collect()
    assert len([r for r in index if r.record_type != "warcinfo"]) == len(sample())
    for r in index:
        headers, payload = warc.read_at(files[r.archive], r.offset, r.length)
        assert headers["warc-record-id"] == r.record_id and headers["warc-type"] == r.record_type
        if r.record_type == "response":
            assert int(headers["x-payload-length"]) == len(payload)
    for content in files.values():
        assert gzip.decompress(content).startswith(b"WARC/1.1")


def test_records_over_chunk_borders():
    made = [warc.make_record(i, "u", b"\r\n\r\n" * i, None) for i in range(30)]
    whole = b"".join(made)
    for step in (1, 7, 1000):
        assert list(warc.records(whole[i : i + step] for i in range(0, len(whole), step))) == made
