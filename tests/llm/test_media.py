import hashlib
import zlib

import pytest

from pricelens.llm import media as M


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 33, "long " * 5000])
def test_png_round_trip(text):
    n, payload = M.padded(text)
    assert n == len((text or "").encode()) and len(payload) % 64 == 0 and payload[:n] == (text or "").encode() and len(payload) > 0
    assert M.from_png(M.to_png(payload)) == payload


def test_features_by_hand():
    # 32 bytes 0 and 32 bytes 255: mean 127.5, variance 127.5 squared, one bit of entropy.
    assert M.feature(bytes(32) + b"\xff" * 32) == "mean=127500;var=16256250;entropy=1000;bins=32,0,0,0,0,0,0,32"
    assert M.feature(bytes(64)) == "mean=0;var=0;entropy=0;bins=64,0,0,0,0,0,0,0"
    raw = bytes(range(256))
    mean = sum(raw) / 256
    var = sum((x - mean) ** 2 for x in raw) / 256
    assert M.feature(raw) == f"mean={round(mean * 1000)};var={round(var * 1000)};entropy=8000;bins=" + ",".join(["32"] * 8)


def test_standard_png_layout():
    """The stored form by the file format's own rules: signature, header fields, and rows behind a filter byte 0."""
    payload = bytes(range(128))
    png = M.to_png(payload)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[12:16] == b"IHDR" and int.from_bytes(png[16:20]) == 64 and int.from_bytes(png[20:24]) == 2
    assert png[24:29] == bytes([8, 0, 0, 0, 0]) and png[-8:-4] == b"IEND"
    at = png.index(b"IDAT")
    rows = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at])])
    assert rows == b"\0" + payload[:64] + b"\0" + payload[64:]


def test_hot_digests_null_digests_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT", 4)
    png = M.to_png(b"a" * 64)
    d = hashlib.sha256(png).hexdigest()
    html = f'<img src="sha256:{d}" alt="hot"><p>text</p>'
    df = spark.createDataFrame([(k, html, "old", 1, 2, 3) for k in range(300)], "doc_id long, html string, items string, digest int, position int, feature int")
    got = M.resolve(M.sequences(df), M.facts(spark.createDataFrame([(d, bytearray(png))] * 3, "digest string, media binary"))).collect()
    assert sorted((r["doc_id"], r["position"], r["kind"], r["payload_bytes"]) for r in got) == sorted(x for k in range(300) for x in ((k, 0, "media", 64), (k, 1, "text", None)))
    assert M.resolve(M.sequences(df.limit(0)), M.facts(spark.createDataFrame([], "digest string, media binary"))).count() == 0


def test_damage_is_noticed():
    png = bytearray(M.to_png(b"\1" * 128))
    png[50] ^= 1
    with pytest.raises(ValueError):
        M.from_png(bytes(png))


def test_query_on_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = M.query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        n, payload = M.padded(texts[r["doc_id"]])
        png = M.to_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), M.feature(payload))


def test_sequences_stay_aligned(spark):
    pngs = [M.to_png(bytes([k]) * 64) for k in (1, 2)]
    d = [hashlib.sha256(p).hexdigest() for p in pngs]
    pages = [
        (1, f'<h1>T</h1><p>One</p><figure><img src="sha256:{d[0]}" alt="x"><figcaption>Cap &amp; 1</figcaption></figure><p>Two <img src="sha256:{d[1]}" alt="alt 2"> three</p><img src="http://a/b.png"><img src="sha256:feed">'),
        (2, None),
        (3, f'<figure><figcaption>First</figcaption><img src="sha256:{d[0]}"></figure>' * 3),
        (1, "<p>x</p>"),
    ]
    df = M.sequences(spark.createDataFrame([(k, h, "n") for k, h in pages], "page_id long, html string, text string"))
    media = spark.createDataFrame([(d[0], bytearray(pngs[0])), (d[1], bytearray(pngs[1])), (d[0], bytearray(pngs[0]))], "digest string, media binary")
    rows = sorted((r["page_id"], r["position"], r["kind"], r["text"], r["payload_bytes"], r["payload_sha256"]) for r in M.resolve(df, M.facts(media)).collect() if r["text"] != "x")
    sha = [hashlib.sha256(bytes([k]) * 64).hexdigest() for k in (1, 2)]
    assert rows == [
        (1, 0, "text", "T", None, None),
        (1, 1, "text", "One", None, None),
        (1, 2, "media", "Cap & 1", 64, sha[0]),
        (1, 3, "text", "Two", None, None),
        (1, 4, "media", "alt 2", 64, sha[1]),
        (1, 5, "text", "three", None, None),
        (1, 6, "media", "", None, None),
        (1, 7, "media", "", None, None),
        (3, 0, "media", "First", 64, sha[0]),
        (3, 1, "media", "First", 64, sha[0]),
        (3, 2, "media", "First", 64, sha[0]),
    ]
