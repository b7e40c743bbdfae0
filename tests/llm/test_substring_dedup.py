import hashlib
import random

import pytest

from pricelens.llm import substring_dedup as S
from pricelens.llm import textkernel


def split(text):
    return (text or "").encode().split()


def brute(rows):
    seen, gone = set(), {}
    for k, t in sorted(rows):
        w = split(t)
        out = set()
        for i in range(len(w) - 19):
            win = tuple(w[i : i + 20])
            if win in seen:
                out |= set(range(i, i + 20))
            seen.add(win)
        gone[k] = (len(w), len(out), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in out)).hexdigest())
    return gone


def run(spark, rows, parts=3, **settings):
    df = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, n_words string").repartition(parts)
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.dedup(spark, df, S.Settings(**settings)).collect()}


def sample(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}é" for k in range(200)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(18, 60))] for _ in range(6)]
    rows = []
    for k in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 50))]
        rows.append((k * 7 - 50, rng.choice([" ", "\n", " \x0b "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 60), (1003, "a " * 19), (1004, "a " * 20), (1005, "a b " * 40), (1006, " ".join(vocab)), (1007, " ".join(vocab)), (-999, " ".join(vocab))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [300, 1 << 21])
def test_like_brute_force(spark, chunk):
    rows = sample(1)
    assert run(spark, rows, chunk=chunk) == brute(rows)


def test_small_sketch_changes_nothing(spark):
    rows = sample(2)
    # Four ranges of 64 cells for thousands of runs: nearly every window goes to the exact pass.
    assert run(spark, rows, cells=1 << 6, ranges=4, chunk=500) == brute(rows)


def test_small_buffers_and_slices_change_nothing(spark):
    rows = sample(4)
    assert run(spark, rows, chunk=300, runs=20, windows=30, settle=50, ranges=8) == brute(rows)


def test_one_passage_in_every_document(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join([f"u{k}x{rng.random()}", passage, *(f"v{k}x{j}" for j in range(rng.randint(0, 30)))])) for k in range(400)]
    assert run(spark, rows, parts=7, chunk=2000, runs=100, windows=100) == brute(rows)


def test_very_long_text(spark):
    rows = [(1, "a b c d e " * 60_000), (2, " ".join(f"w{k % 90_001}" for k in range(150_000))), (3, "x" * 400_000)]
    assert run(spark, rows) == brute(rows)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(25))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in S.dedup(spark, df).collect())
    # Both rows of 2 lose the places at which either holds a later window; b's own places 0 to 24 are among a's.
    assert got == [(1, 50, 0), (2, 25, 25), (2, 50, 50), (3, 25, 25)]


def test_repeated_rows(spark):
    rows = [(1, "a b " * 15), (1, "a b " * 15), (2, "a b " * 15), (None, "c " * 30), (None, "c " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in S.dedup(spark, df).collect())
    assert got == [(0, 0), (0, 0), (1, 28), (1, 28), (2, 30)]


def test_query_on_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.query(spark, sf).collect()} == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_sketch_never_underestimates():
    import numpy as np
    import pyarrow as pa

    rows = [t for _, t in sorted(sample(3))]
    counts, cells = {}, {}
    for c in textkernel.chunks(pa.array(rows, pa.string())):
        least, place = S._minimizers(c.hashes(), 20, 8)
        ok = S._inside(c, 20)
        whole = S._windows(c.hashes(), 20, 41)
        for h, m in zip(whole[ok], least[ok], strict=True):
            counts[(int(h), int(m))] = counts.get((int(h), int(m)), 0) + 1
        for m, _ in set(zip(least[ok].tolist(), place[ok].tolist(), strict=True)):
            cells[m] = cells.get(m, 0) + 1
    assert all(cells[m] >= n for (_, m), n in counts.items())
    assert len(np.unique([h for h, _ in counts])) == len(counts)
