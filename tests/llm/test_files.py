import base64
import gzip
import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import media, sharding, warc


def test_netpbm_and_bmp():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.pgm(grey.tobytes(), 4)) == grey).all()
    assert (media.decode(b"P2 # c\n4 3\n11\n" + " ".join(map(str, range(12))).encode()) == np.round(grey.astype(int) * 255 / 11)).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    colour = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6 3 2 255\n" + colour.tobytes()) == colour).all()
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    rows = b"".join(colour[y, :, ::-1].tobytes() + b"\0" * 3 for y in (1, 0))
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, 3, 2, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == colour).all()
    head = lambda bits, packed, at, w, h: b"BM" + struct.pack("<IIIIiiHHIIiiII", 0, 0, at, 40, w, h, 1, bits, packed, 0, 0, 0, 0, 0)
    masked = head(32, 3, 66, 2, -1) + struct.pack("<III", 0xFF, 0xF00, 0x3000000) + struct.pack("<II", 0x1000A12, 0x3000FFF)
    assert media.decode(masked).tolist() == [[[0x12, 0xAA, 85], [255, 255, 255]]]
    beyond = head(8, 0, 62, 4, 1) + bytes(8) + bytes([0, 1, 2, 9])
    huge = [b"P5 99999999999 99999999999 255\nx", b"P2 1 1 255\n99999999999999999999999", b"P2 1 1 255\n300", b"P2 1 1 0\n0", b"P5 0 4 255\n", b"P2 1 1 255\nx"]
    for bad in (b"", b"P5\n4", b"P5 4 4 255\nxx", b"GIF89a", beyond, *huge, head(8, 0, 62, -4, 1) + bytes(12), head(24, 3, 54, 1, 1) + bytes(4), head(24, 0, 54, 2**31 - 1, 2**31 - 1)):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=100, deadline=None)
def test_resizing_is_the_mean_of_areas(h, w, height, width, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w))
    fine = np.kron(image, np.ones((height, width)))
    want = fine.reshape(height, h, width, w).mean((1, 3))
    assert np.allclose(media.resized(image, height, width), want)


@given(st.integers(0, 40), st.integers(1, 7))
@settings(max_examples=50, deadline=None)
def test_npy(h, w):
    image = np.random.default_rng(h).integers(0, 256, (h, w), np.uint8)
    held = io.BytesIO()
    np.save(held, image)
    assert media.npy(image) == held.getvalue() and (media.from_npy(media.npy(image)) == image).all()


def test_media_of_texts(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 288), (5, "y" * 577), (1, "abc"), (None, "😀" * 40000)]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, feature string")
    got = media.report(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[d] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] and r.media_bytes > r.payload_bytes and len(r.feature) == 16
    assert len({tuple(r)[1:] for r in got if r.doc_id == 1}) == 1 and media.report(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([("k", b"junk"), ("n", None), ("p", media.pgm(bytes(6), 3))], "doc_id string, image binary")
    assert {r.doc_id: (r.tiles is None, r.error) for r in media.store(odd).collect()} == {"k": (True, "neither Netpbm nor BMP"), "n": (True, "null"), "p": (False, None)}


@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_schedule(sizes, shards):
    units = [(s, f"u{k:03d}") for k, s in enumerate(sizes)]
    place = sharding.schedule(units, shards)
    loads = [sum(s for s, n in units if place[n] == k) for k in range(shards)]
    assert set(place) == {n for _, n in units} and max(loads) <= max(sum(sizes) / shards + max(sizes, default=0), max(sizes, default=0))


def test_shards(spark):
    rows = [(i, f"text {i % 60} " + "x" * (i % 37)) for i in range(800)] + [(1000 + i, "hot copy " * 9) for i in range(300)] + [(5, None), (6, ""), (None, "n"), (7, "text 7"), (7, "text 7")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, shard int").repartition(5)
    got = sharding.assign(docs, shards=4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    homes, loads = {}, [0] * 4
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in homes.values())
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    hot = sum(len(t or "") + 8 for d, t in rows if d is not None and d >= 1000)
    rest = [x for x in loads if x < hot]
    assert max(rest) - min(rest) <= 3000 or max(rest) < 1.3 * min(rest)
    assert sharding.assign(docs.limit(0)).collect() == []


def test_archives_of_a_hot_page(spark, tmp_path):
    hot = spark.range(50_000).selectExpr("7 as page_id", "concat('u', id) as url", "concat('<p>', id % 1000, '</p>') as html")
    pages = hot.union(spark.range(3000).selectExpr("id * 1000003 % 7919 as page_id", "'v' as url", "concat('<b>', id % 50, '</b>') as html")).repartition(3)
    made = [warc.write(pages, f"file://{tmp_path}/h{k}", tasks=8, roll_bytes=200_000) for k in range(2)]
    assert made[0] == made[1] and sum(m["records"] for m in made[0]) == 53_000
    assert len({m["name"][:13] for m in made[0]}) >= 8 and max(m["records"] for m in made[0]) < 15_000
    for m in made[0]:
        assert (tmp_path / "h0" / m["name"]).read_bytes() == (tmp_path / "h1" / m["name"]).read_bytes()
    read = warc.read(spark, f"file://{tmp_path}/h0")
    assert read.count() == 53_000 and read.where("page_id = 7 and record_type <> 'response'").count() == 0


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/ é\r\n", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, "<p>other</p>"), (9, "u", None), (8, "v", ""), (5, "w", "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "again", "<p>same</p>"), (None, "x", "<p>same</p>"), (7, "y", "z" * 200_000), (6, "t", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, first string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder, roll_bytes=300, tasks=3)
    assert len(manifest) > 3 and warc.write(pages, f"file://{tmp_path}/again", roll_bytes=300, tasks=3) == manifest
    for m in manifest:
        assert (tmp_path / "w" / m["name"]).read_bytes() == (tmp_path / "again" / m["name"]).read_bytes()
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()), key=str)
    least: dict = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, u, h in rows:
        raw = (h or "").encode()
        again = p is not None and p > least[h or ""]
        want.append((p, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None))
    assert got == sorted(want, key=str)
    big = warc.read(spark, f"file://{tmp_path}/w", warc.write(pages, folder, revisit_from=12)).where("record_type = 'revisit'").collect()
    assert big == []
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_temporary")]
    records = warc.read(spark, folder).collect()
    by_id = {r.record_id: r for r in records}
    assert len(by_id) == len(rows)
    for r in records:
        if r.record_type == "revisit":
            first = by_id[r.refers_to_id]
            assert first.record_type == "response" and (first.page_id, first.url, first.payload_digest) == (1, "again", r.payload_digest)
            with gzip.open(tmp_path / "w" / r.file) as f:
                text = f.read().decode()
            assert f"WARC-Refers-To: {first.record_id}\r\nWARC-Refers-To-Target-URI: again\r\nWARC-Refers-To-Date: 20" in text
    (name,) = {r.file for r in records if r.record_type == "response" and r.page_id == 1 and r.url == "again"}
    (tmp_path / "w" / name).unlink()
    with pytest.raises(Exception, match="refers to no such"):
        warc.read(spark, folder, [m for m in manifest if m["name"] != name]).collect()
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert empty == [] and warc.read(spark, f"file://{tmp_path}/e").collect() == []
