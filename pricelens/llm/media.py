"""Media columns: interleaved text and media sequences with payloads resolved by digest.

`sequences` parses html into ordered structs (position, kind, text, digest): text blocks, and media references whose text
is their caption (the figure's figcaption, else the alternative text). References are content addresses,
`sha256:<hex of the stored form>`. `resolve` joins them with what a media table says of each digest; positions and
captions stay in their rows, so they remain aligned whatever the join does. A digest's facts are computed from the stored
bytes, read back, and reduced to one row a digest before the join; payloads are never shuffled.

Bytes are stored as 8-bit greyscale PNG images, 64 samples wide: lossless, and standard.

Defined results: null html or text counts as empty; a reference that is no content address, or whose digest isn't
stored, keeps its position and caption with null facts; repeated rows, digests and references are all kept; equal
payloads have equal stored forms.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType

from .common import documents, written
from .dom import walk
from .packing import slices

WIDTH = 64
PREFIX = "sha256:"
#: Digests that count as hot are fewer than HOT; their references meet the facts in SALTS parts.
HOT, SALTS = 1000, 32
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
BYTES = 8 << 20


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: with bytes 0 up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image, WIDTH samples wide, unfiltered rows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _part(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of an image as to_png writes it; its checksums are verified."""
    if not png.startswith(_SIGNATURE):
        raise ValueError("no PNG image")
    at, body, head = len(_SIGNATURE), [], b""
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("damaged PNG image")
        head = data if kind == b"IHDR" else head
        if kind == b"IDAT":
            body.append(data)
        at += 12 + n
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head)
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, variance and entropy (thousandths) of the samples, and a histogram of 8 equal ranges."""
    n = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    total, values = n.sum(), np.arange(256)
    mean = (n * values).sum() / total
    variance = (n * values * values).sum() / total - mean * mean
    p = n[n > 0] / total
    entropy = -(p * np.log2(p)).sum()
    bins = n.reshape(8, 32).sum(axis=1)
    return f"mean={round(mean * 1000)};var={round(variance * 1000)};entropy={round(abs(entropy) * 1000)};bins=" + ",".join(map(str, bins.tolist()))


def items(html: str | None) -> list[tuple[str, str, str | None]]:
    """(kind, text, digest) in page order. A figure's caption goes to its media and is no text item of its own."""
    leaves = walk(html or "")
    figure = lambda x: x.node and x.node.figure
    caption = lambda x: x.ref is None and x.node is not None and x.node.caption
    out: list[tuple[str, str, str | None]] = []
    for k, x in enumerate(leaves):
        near = [y for y in leaves[max(0, k - 1) : k] + leaves[k + 1 : k + 2] if figure(y) is not None and figure(y) is figure(x)]
        if x.ref is not None:
            # The caption after the media goes before the one that precedes it.
            text = next((y.text for y in reversed(near) if caption(y)), x.text)
            out.append(("media", text, x.ref.removeprefix(PREFIX) if x.ref.startswith(PREFIX) else None))
        elif not (caption(x) and any(y.ref is not None for y in near)):
            out.append(("text", x.text, None))
    return out


ITEMS = "array<struct<position:int,kind:string,text:string,digest:string>>"


def sequences(df: DataFrame, html: str = "html") -> DataFrame:
    """df with `items` in place of html, and of a column of that name."""
    keep = [f for f in df.schema.fields if f.name not in (html, "items")]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"position": k, "kind": a, "text": t, "digest": d} for k, (a, t, d) in enumerate(items(h))] for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], names=[*(f.name for f in keep), "items"])

    rows = df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{html}`").cast("string").alias("html to read"))
    return rows.mapInArrow(run, StructType([*keep, *StructType.fromDDL(f"items {ITEMS}").fields]))


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(media: DataFrame) -> DataFrame:
    """FACTS of each digest of (digest, media), from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FACTS.split(", ")]
        for b in batches:
            rows = []
            for digest, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = from_png(png)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return media.select("digest", "media").mapInArrow(run, FACTS).dropDuplicates(["digest"])


def resolve(df: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each item of df, with the facts of its digest; columns of df named like these are replaced.

    A digest of more than 1/HOT of all references (there are fewer than HOT) is looked up in SALTS parts, and items without
    a digest, which find nothing, are dealt evenly, so neither meets in one task."""
    names = ["position", "kind", "text", "digest", *(c for c in known.columns if c != "digest")]
    keep = [c for c in df.columns if c not in (*names, "items")]
    flat = df.select(*(F.col(f"`{c}`") for c in keep), F.explode("items").alias("item")).select(*(F.col(f"`{c}`") for c in keep), "item.*")
    counts = flat.filter("digest IS NOT NULL").groupBy("digest").count()
    counts = written(df.sparkSession, counts, "digests")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r["digest"] for r in counts.filter(F.col("count") * HOT > total).collect() if r["count"] >= SALTS]  # fewer than HOT
    plain = [f.name for f in flat.schema.fields if isinstance(f.dataType, AtomicType)]
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.when(F.col("digest").isNull(), 1 << 16).when(F.col("digest").isin(hot), SALTS).otherwise(1))
    salts = F.when(F.col("digest").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    facts_ = known.withColumn("salt to join", F.explode(salts))
    joined = flat.withColumn("salt to join", salt.cast("long")).join(facts_, ["digest", "salt to join"], "left")
    return joined.select(*(F.col(f"`{c}`") for c in (*keep, *names)))


def store(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Each row's text as a stored image with its digest, and the html that refers to it: doc_id, n_bytes, html, digest,
    media, as a table in the shared folder. It may hold a digest more than once, as tasks write on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), BYTES):
                n, html, digest, media = [], [], [], []
                for text in b.column(1).slice(lo, hi - lo).to_pylist():
                    size, payload = padded(text)
                    png = to_png(payload)
                    d = hashlib.sha256(png).hexdigest()
                    n.append(size)
                    media.append(png)
                    digest.append(d)
                    html.append(f'<figure><img src="{PREFIX}{d}" alt=""><figcaption>{size} bytes</figcaption></figure>')
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(html, pa.string()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "html", "digest", "media"])

    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(spark, rows.mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, media binary"), "media")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(spark, documents(spark, sf_dir))
    rows = resolve(sequences(stored.select("doc_id", "n_bytes", "html")), facts(stored))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", F.col("text").alias("caption"))
