import os
import random
import subprocess
import sys
from itertools import combinations

import numpy as np

from pricelens.llm import minhash_dedup as M


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")


def shingles(text, n):
    w = [x for x in words(text) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    sets = {k: shingles(t, n) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def run(spark, rows, n):
    df = spark.createDataFrame([(k, t, "z", 7) for k, t in rows], "doc_id long, text string, component string, node int")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.groups(spark, df, shingle=n).collect()}


def near_copies(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.03, 0.08]) else w for w in base]
            rows.append((k, " ".join(copy)))
            k += 1
    edge = [None, "", " \t\n ", "one", "ONE", "one\x0btwo", "one two", "one two three", "é É", "É é", "a b " * 50, "a b c"]
    return rows + [(k + j, t) for j, t in enumerate(edge)]


def test_like_brute_force(spark):
    rows = near_copies(3)
    assert run(spark, rows, 2) == brute(rows, 2)


def test_five_words(spark):
    rows = near_copies(4)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_big_group_of_copies(spark):
    rows = [(k, "same words here and there again " * 9 + ("x" if k % 100 == 0 else "")) for k in range(600)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 4)
    monkeypatch.setattr(M, "CLUSTER_ROWS", 3)
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) if rng.random() < rng.choice((0.03, 0.1)) else w for w in base)) for k in range(60)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_linked_like_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    sets += [s[: max(1, len(s) - 2)] for s in sets[:30]]
    component = np.arange(len(sets))
    forest = M._Forest(component)
    true = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    for a, b in true:
        forest.parent[forest.find(a)] = forest.find(b)
    got = M._Forest(component)
    for a, b in M._linked(sets, component, 80):
        assert (max(a, b), min(a, b)) in true
        got.parent[got.find(a)] = got.find(b)
    pairs = lambda f: {(a, b) for a in range(len(sets)) for b in range(a) if f.find(a) == f.find(b)}
    assert pairs(got) == pairs(forest)


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (1, b), (3, b + " x"), (4, a + " x"), (5, "c d e"), (7, "q r s"), (6, "c d e"), (6, "q r s"), (9, "q r s"), (None, a)]
    got = M.groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (9, 5), (None, None)}
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert run(spark, [], 2) == {}


#: The task of signatures() over a batch of 16 MB; prints its rows and the MB that it still holds when it is done.
_TASK = """
import random, re
import pyarrow as pa
from unittest import mock
from pricelens.llm import minhash_dedup as M

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Frame:
    def mapInArrow(self, run, schema):
        return run

M._rows = lambda df: Frame()
run, rng = M.signatures(None, 5), random.Random(3)
words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(40_000)]
texts = [" ".join(rng.choices(words, k=300)) for _ in range((16 << 20) // 2_000)]
batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text_hash", "text"])
rows = sum(map(len, run(iter([batch.slice(0, 9)]))))
before = mb()
rows += sum(map(len, run(iter([batch]))))
print(rows, mb() - before)
"""


def test_task_gives_memory_back():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", _TASK], cwd=here, capture_output=True, text=True, timeout=300, check=True)
    rows, held = map(float, said.stdout.split())
    assert rows > 8_000 and held < 30, said.stdout
