import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from pricelens.llm import packing as P
from pricelens.llm.tokens import tokenizer_path


def tokens(text):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, got):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    ids = {k: np.array(tokens(t), dtype="<u4") for k, t in rows}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    pieces = Counter(r["doc_id"] for r in got)
    assert pieces == {k: -(-len(v) // 1024) for k, v in ids.items()}
    total = sum(len(v) for v in ids.values())
    assert sum(r["length"] for r in got) == total
    return len(by), -(-total // 1024)


def test_query_on_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check(rows, P.query(spark, sf).collect())
    assert used <= least + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x " * 5000), (4, "a"), (5, "word " * 1023), (6, "word " * 1022), (7, "x<|endoftext|> y\n<|endoftext|>")]
    df = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, length int")
    check(rows, P.pack(spark, df, tokenizer_path("byte_bpe_50k.json")).collect())
    assert P.pack(spark, df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plan_uses_histogram_up():
    rng = np.random.default_rng(1)
    for top in (40, 300, 1023):
        h = np.zeros(1025, dtype=np.int64)
        np.add.at(h, rng.integers(1, top + 1, 5000), 1)
        h[1024], h[700 % top + 1] = 17, 4000
        back = np.zeros_like(h)
        kinds = P.plan(h)
        for kind, n in kinds:
            assert sum(kind) <= 1024
            for x in kind:
                back[x] += n
        assert (back == h).all()
        least = -(-int((np.arange(1025) * h).sum()) // 1024)
        halves = int(h[513:].sum())
        assert sum(n for _, n in kinds) <= max(least, halves) * 1.02 + 1


def test_patterns_fill_and_fit():
    rng = np.random.default_rng(4)
    lengths = sorted(set(rng.integers(1, 1024, 300).tolist()))
    found = P.patterns(lengths, 1024)
    assert {len(p) for p in found} >= {2, 3, 4, 5, 6} and len(set(found)) == len(found)
    assert all(sum(p) <= 1024 and set(p) <= set(lengths) for p in found)
    x = rng.integers(0, 50, len(found)) * (rng.random(len(found)) < 0.05)
    h = np.zeros(1025)
    for p, n in zip(found, x, strict=True):
        for k in p:
            h[k] += n
    y = P.fit(h, found)
    made = np.zeros(1025)
    for p, n in zip(found, y, strict=True):
        for k in p:
            made[k] += n
    assert (y >= 0).all() and np.linalg.norm(made - h) < 0.05 * np.linalg.norm(h)


def test_fitted_plan_no_worse_than_best_fit_alone():
    rng = np.random.default_rng(8)
    fewer = 0
    for k in range(12):
        h = np.zeros(1025, dtype=np.int64)
        np.add.at(h, np.clip((rng.gamma(2, 40 * (k + 1), 20_000)).astype(int), 1, 1023), 1)
        alone = sum(n for _, n in P.best_fit(h, 1024))
        own = sum(n for _, n in P.plan(h))
        assert own <= alone
        fewer += own < alone
    assert fewer


#: The task of packing.pieces() over two batches of 16 MB; prints its rows and the MB that it adds at most.
_TASK = """
import random, re
from unittest import mock
import pyarrow as pa
from pricelens.llm import packing as P
from pricelens.llm.tokens import encoder, tokenizer_path

def mb(k):
    return int(re.search(rf"{k}:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Frame:
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

P.F, P.TaskContext = mock.MagicMock(), mock.MagicMock()
P.TaskContext.get.return_value.partitionId.return_value = 0
run, rng = P.pieces(Frame(), tokenizer_path("byte_bpe_50k.json")), random.Random(3)
words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(40_000)]
texts = [" ".join(rng.choices(words, k=500)) for _ in range(2 * (16 << 20) // 3_300)]
half = len(texts) // 2
batches = [pa.record_batch([pa.array(range(half)), pa.array(x)], ["doc_id", "text"]) for x in (texts[:half], texts[half:])]
rows = sum(map(len, run(iter([batches[0].slice(0, 9)]))))
del texts
open("/proc/self/clear_refs", "w").write("5")
peak = mb("VmHWM")
rows += sum(map(len, run(iter(batches))))
print(rows, mb("VmHWM") - peak)
"""


def test_task_holds_little_memory():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", _TASK], cwd=here, capture_output=True, text=True, timeout=300, check=True)
    rows, peak = map(float, said.stdout.split())
    assert rows > 9_000 and peak < 150, said.stdout
