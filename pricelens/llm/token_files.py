"""Token ids in flat binary files.

A part has two files in the shared folder: NAME.ids holds the ids of its documents one after the other, as unsigned
integers of two or four bytes, little-endian; NAME.idx holds, as 64-bit integers, the magic number, the bytes an id
takes, the number of documents, the documents' ids, and one more offset than documents (in ids, from 0). Parts hold
ranges of ascending document ids. A part's base, the ids before it, is a prefix sum over the parts.

A task writes under names of its own and names them in its row; files of lost or repeated tasks are never read. Files in
a folder that is mounted locally are memory-mapped; others are read through pyarrow's file systems.

Defined results: null text counts as empty and holds only the end id; null document ids come first and are stored as
the smallest integer; repeated ids each keep a place (by text); an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, written
from .packing import slices
from .tokens import encoder, tokenizer_path

END, MAGIC = 2, 0x544F4B31
NONE = -(1 << 63)
#: Text of a slice; words repeat more in larger ones.
BYTES = 12 << 20


def _open(folder: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _local(folder: str) -> bool:
    return folder.startswith(("file:", "/"))


def write_parts(df: DataFrame, folder: str, path: str, end: int = END, parts: int | None = None) -> DataFrame:
    """Writes the ids of (doc_id, text) in ascending doc_id order; a row for each part: first, name, width, docs, ids."""
    wide = encoder(path).t.get_vocab_size() > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, kind = encoder(path), "<u4" if wide else "<u2"
        name, ids_of, sizes, out = uuid.uuid4().hex, [], [], None
        fs, root = _open(folder)
        for b in batches:
            for lo, hi in slices(b.column(1), BYTES):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.ids")
                ids, bounds = e.encode(b.column(1).slice(lo, hi - lo))
                n = hi - lo
                full = np.full(len(ids) + n, end, dtype=kind)
                keep = np.ones(len(full), dtype=bool)
                keep[bounds[1:] + np.arange(n)] = False
                full[keep] = ids
                out.write(full)
                sizes.append(np.diff(bounds) + 1)
                ids_of.append(b.column(0).slice(lo, n).fill_null(NONE).to_numpy())
        if out is None:
            return
        out.close()
        doc, size = np.concatenate(ids_of), np.concatenate(sizes)
        with fs.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.array([MAGIC, np.dtype(kind).itemsize, len(doc)], dtype="<i8"))
            index.write(doc.astype("<i8"))
            index.write(np.concatenate([[0], np.cumsum(size)]).astype("<i8"))
        yield pa.RecordBatch.from_pydict({"first": [int(doc[0])], "name": [name], "docs": [len(doc)], "ids": [int(size.sum())]})

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "first long, name string, docs long, ids long")


def read_part(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, offsets (one more) and token ids of a part, memory-mapped where the folder is local."""
    fs, root = _open(folder)
    if _local(folder):
        head = np.memmap(f"{root}/{name}.idx", dtype="<i8", mode="r")
    else:
        with fs.open_input_file(f"{root}/{name}.idx") as f:
            head = np.frombuffer(f.read(), dtype="<i8")
    if head[0] != MAGIC:
        raise ValueError(f"{name}.idx is no token index")
    kind, n = {2: "<u2", 4: "<u4"}[int(head[1])], int(head[2])
    if _local(folder):
        ids = np.memmap(f"{root}/{name}.ids", dtype=kind, mode="r") if os.path.getsize(f"{root}/{name}.ids") else np.zeros(0, kind)
    else:
        with fs.open_input_file(f"{root}/{name}.ids") as f:
            ids = np.frombuffer(f.read(), dtype=kind)
    return head[3 : 3 + n], head[3 + n :], ids


def read_documents(spark: SparkSession, parts: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files. parts: as write_parts returns them.

    The list of parts (one row a partition) is ordered on the driver for the prefix sums."""
    rows = sorted(parts.collect(), key=lambda r: r["first"])
    bases = [0, *accumulate(r["ids"] for r in rows)]
    work = spark.createDataFrame([(r["name"], b) for r, b in zip(rows, bases, strict=False)], "name string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc, offsets, ids = read_part(folder, name)
                for lo in range(0, len(doc), 4096):
                    hi = min(len(doc), lo + 4096)
                    at = np.array(offsets[lo : hi + 1])
                    block = np.array(ids[at[0] : at[-1]]).astype("<u4")
                    crc = [zlib.crc32(block[x:y]) for x, y in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                    own = np.array(doc[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NONE), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return work.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, df: DataFrame, path: str, end: int = END) -> DataFrame:
    folder = f"{shared_dir(spark)}/pricelens/tokens-{uuid.uuid4().hex}"
    return read_documents(spark, written(spark, write_parts(df, folder, path, end), "parts"), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
