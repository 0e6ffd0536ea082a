import hashlib

import pytest

from tessera.llm import warc
from tessera.llm._common import shared_path

BIG = "x" * 1200


def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, None, None), (6, "http://a/6", "é" * 600), (9, "http://a/\r\n9", BIG), (7, "u", "é" * 600), (8, "", "\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    df = pages(spark)
    out = {r.id: r for r in warc.round_trip(df).collect()}
    for r in df.collect():
        raw = (r.html or "").encode()
        got = out[r.page_id]
        assert (got.payload_bytes, got.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = {1: 9, 2: 9, 6: 7}.get(r.page_id)
        assert (got.record_type, got.refers_to) == (("revisit", again) if again else ("response", None))
        assert bytes(got.block) == (b"" if again else raw)


def test_one_record_by_its_place(spark):
    df = spark.range(300).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('page ', id, ' '), 50) AS html")
    out = shared_path(spark, "warc-test")
    index = warc.write_bundles(df, out, frame_bytes=4096, bundle_bytes=8192).collect()
    assert len(index) == 300 and len({r.bundle for r in index}) > 1 and max(r.frame for r in index) > 1
    for r in index[::23]:
        head, block = warc.read_record(out, r.bundle, r.frame, r.offset)
        assert head["WARC-Record-ID"] == f"<urn:page:{r.id}>" and block.decode() == f"page {r.id} " * 50
    places = {(r.id, r.bundle, r.frame, r.offset) for r in index}
    assert {(r.id, r.bundle, r.frame, r.offset) for r in warc.read_bundles(spark, out).collect()} == places


def test_frames_are_independent_and_the_footer_is_standard():
    writer = warc.BundleWriter(frame_bytes=100)
    raws = [bytes([k]) * 60 for k in range(5)]
    places = [writer.add(r) for r in raws]
    bundle = writer.finish()
    table = warc.seek_table(bundle)
    assert [p[0] for p in places] == [0, 1, 2, 3, 4] and len(table) == 5
    assert warc.read_frame(bundle, 3) == raws[3]
    import io

    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle), read_across_frames=True) as f:
        assert f.read() == b"".join(raws)  # skippable frames are skipped by any reader
    with pytest.raises(ValueError):
        warc.seek_table(b"x" * 20)


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(1, "u", BIG, 1), (1, "u", BIG, 1), (None, "u", BIG, 2), (2, "v", "y" * 3_000_000, 3)], "page_id long, url string, html string, digest int")
    out = warc.round_trip(df).collect()
    assert sorted((r.id or 0, r.record_type) for r in out) == [(0, "response"), (1, "response"), (1, "response"), (2, "response")]
    assert warc.round_trip(df.limit(0)).count() == 0
