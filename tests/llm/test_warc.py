import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, warc
from assayer.llm.shared import fresh_path


def brute(pages):
    seen = {}
    for p, h in pages:
        if p is not None and len((h or "").encode()) >= 1000:
            seen[h] = max(seen.get(h, p), p)
    out = []
    for p, h in pages:
        data = (h or "").encode()
        first = seen.get(h) if len(data) >= 1000 else None
        again = first is not None and first != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def key(r):
    return str(tuple(r))


def test_query_matches_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(key, queries.op5_warc(spark, sf_dir).collect())) == sorted(map(key, brute(pages)))


def test_revisits_edges_and_pushdown(spark):
    big, other = "é" * 600, "x" * 999
    pages = [(1, big), (7, big), (7, big), (3, big), (4, other), (5, other), (6, None), (8, ""), (None, big), (None, "y" * 2000), (None, "y" * 2000)]
    df = spark.createDataFrame([(p, None if p == 4 else f"http://h/{p}\r\nX: y", h, 1) for p, h in pages], "page_id bigint, url string, html string, payload int")
    path = fresh_path(spark, "warc")
    warc.write(df, path, roll_mb="0.001")
    rows = warc.read(spark, path)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows.collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(pages)))
    text = {(r.page_id, r.payload.decode()) for r in rows.where("record_type = 'response'").collect()}
    assert (7, big) in text and (6, "") in text and (1, big) not in text
    ids = {r.record_id for r in rows.where("page_id = 7").collect()}
    assert {r.refers_to_id for r in rows.where("record_type = 'revisit'").collect()} == ids
    slim = warc.read(spark, path, "record_type string, page_id bigint, target_uri string")
    plan = slim.where("record_type = 'revisit' and page_id in (1, 3)")
    assert sorted(r.page_id for r in plan.collect()) == [1, 3]
    assert slim.where(F.col("target_uri").startswith("http://h/5")).count() == 1 and slim.where("target_uri is null").count() == 1
    empty = fresh_path(spark, "warc")
    warc.write(df.where(F.lit(False)), empty)
    assert warc.read(spark, empty).count() == 0


def test_unwanted_payloads_are_not_unpacked(monkeypatch):
    data = b"".join(warc.member(warc.record(i, "u", bytes([97 + i % 20]) * 50_000, "response", None, "00" * 20, "d"), 1) for i in range(8))
    unpacked = []
    real = warc.zlib.decompressobj

    class Counted:
        def __init__(self, *a):
            self.inner = real(*a)

        def decompress(self, *a):
            out = self.inner.decompress(*a)
            unpacked.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    found = list(warc.records(io.BytesIO(data), lambda h: h["x-page-id"] == "5", True))
    assert len(found) == 1 and found[0][1].endswith(b"f" * 50_000) and sum(unpacked) < 50_000 + 8 * 2100


@pytest.mark.parametrize("pack", [lambda r: b"".join(r), lambda r: b"".join(map(gzip.compress, r)), lambda r: b"".join(warc.member(x, 6) for x in r)])
@pytest.mark.parametrize("body", [True, False])
def test_other_archives_can_be_read(pack, body):
    records = [warc.record(i, f"http://x/{i}", b"p" * (i * 7000), "response", None, "00" * 20, "d") for i in range(30)]
    found = list(warc.records(io.BytesIO(pack(records)), lambda h: int(h["x-page-id"]) % 3 > 0, body))
    assert [int(h["x-page-id"]) for h, _ in found] == [i for i in range(30) if i % 3]
    if body:
        assert all(b.partition(b"\r\n\r\n")[2] == b"p" * (int(h["x-page-id"]) * 7000) for h, b in found)


def test_malformed_archives(spark, tmp_path):
    good = [warc.record(i, f"http://x/{i}", b"p" * 500, "response", None, "00" * 20, "d") for i in range(3)]
    short = good[0][:-200]
    nameless = good[1].replace(b"Content-Length: 5", b"Kontent-Length: 5")
    odd = good[1].replace(b"X-Page-Id: 1", b"X-Page-Id: one")
    cases = {
        "short.warc": (b"".join([*good, short]), 3), "short.warc.gz": (b"".join(gzip.compress(r) for r in good) + gzip.compress(short), 3), "cut.warc.gz": (b"".join(warc.member(r, 6) for r in good)[:-40], 2),
        "headless.warc": (good[0] + b"junk without an end", 1), "nameless.warc": (good[0] + nameless, 1), "odd.warc.gz": (b"".join(warc.member(r, 6) for r in (good[0], odd, good[2])), 2), "noise.warc.gz": (b"\x1f\x8b" + b"noise" * 50, 0),
    }
    for name, (data, n) in cases.items():
        (tmp_path / name).write_bytes(data)
        path = f"file://{tmp_path}/{name}"
        with pytest.raises(Exception, match=name):
            warc.read(spark, path).collect()
        assert warc.read(spark, path, malformed="drop").count() == n, name


def test_members_too_long_for_their_length_field(monkeypatch):
    monkeypatch.setattr(warc, "_SIZED", 300)
    records = [warc.record(i, "u", bytes(range(256)) * (i * 3), "response", None, "00" * 20, "d") for i in range(4)]
    data = b"".join(warc.member(r, 6) for r in records)
    assert data[3] == 0 and len(list(warc.records(io.BytesIO(data)))) == 4


def test_groups_beyond_the_broadcast_limit_are_joined(spark, monkeypatch):
    pages = [(i, "u", "z" * 1000 + str(i % 4), 0) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, x int")
    told = lambda: sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.planned(df).collect())
    few = told()
    monkeypatch.setattr(warc, "_BROADCAST_ROWS", 0)
    assert told() == few and sum(r[1] == "response" for r in few) == 4
