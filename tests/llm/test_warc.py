import hashlib
import io

import pytest
import zstandard

from tessera.llm import warc


def test_round_trip(spark):
    big, other = "<p>é" * 400, "<b>" * 500
    rows = [(1, "http://a/1", big), (2, "http://a/ 2\r\nX: y", big), (3, None, other), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "u", None), (None, "u", big), (2, "http://a/2", big), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, digest string, size string").repartition(2)
    manifest = warc.write(pages, revisit_bytes=1000, frame_bytes=2000)
    got = sorted((-1 if r["id"] is None else r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(manifest).collect())
    def want(i, html):
        data = (html or "").encode()
        head = 2 if html == big and i != 2 else None
        return -1 if i is None else i, len(data), hashlib.sha1(data).hexdigest(), "response" if head is None else "revisit", head
    assert got == sorted(want(i, h) for i, _, h in rows)
    found = [x for r in manifest.collect() if (x := warc.fetch(r["path"], "3"))]
    assert len(found) == 1 and found[0][1].decode() == other
    assert warc.read_records(warc.write(pages.limit(0))).count() == 0


class Kept(io.BytesIO):
    def close(self):
        pass


def test_bundles_are_zstandard_and_seekable():
    out = Kept()
    writer = warc.BundleWriter(out, 3000)
    records = {str(k): warc.record(k, "u", b"p" * 700 * (k % 3), "d", 700 * (k % 3), None, "t") for k in range(20)}
    for k, r in records.items():
        writer.add(k, r)
    writer.close()
    data = out.getvalue()
    reader = warc.BundleReader(io.BytesIO(data), len(data))
    assert len(reader.places) > 3 and [reader.fetch(k) for k in records] == list(records.values()) and reader.fetch("99") is None
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records.values())
    with pytest.raises(ValueError):
        warc.BundleReader(io.BytesIO(data[:-1] + b"\0"), len(data))
