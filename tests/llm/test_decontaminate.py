import itertools
import math
import random
import re

from pricelens.llm import decontaminate as D


def words(t):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def alike(doc, item):
    """Best agreement over all alignments that hold a stretch that is alike enough, by trying each."""
    a, b = words(doc), words(item)
    best = None
    if len(b) < D.SHORT:
        return None
    for d in range(-len(b), len(a) + 1):
        same = [0 <= d + k < len(a) and a[d + k] == b[k] for k in range(len(b))]
        n = min(len(b), D.LEAST)
        if any(sum(same[k : k + n]) >= math.ceil(D.SHARE * n) for k in range(len(b) - n + 1)):
            best = max(best or 0, sum(same))
    return best


def run(spark, docs, items, most=D.BLOCK):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(docs)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["matched"] for r in D.find(spark, df, bench, most).collect()}


def test_like_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [make(n) for n in (6, 9, 12, 20, 30, 60, 3)]
    docs = []
    for it in items:
        for change in (0, 1):
            for _ in range(2):
                part = it[: rng.randint(max(1, len(it) - 5), len(it))] if change and len(it) > 20 else list(it)
                docs.append(" ".join(make(40) + part + make(30)))
    docs += [None, "", " ".join(make(100)), " ".join(items[3]).upper().replace(" ", ", ")]
    texts = [" ".join(x) for x in items] + [None, ""]
    expected = {(j, k): m for j, d in enumerate(docs) for k, t in enumerate(texts) if (m := alike(d, t)) is not None}
    assert run(spark, docs, texts) == expected
    assert run(spark, docs, texts, most=25) == expected


def test_substitutions(spark):
    rng = random.Random(2)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    changed = [w if k % 9 else f"other{k}" for k, w in enumerate(item)]
    docs = ["before " * 20 + " ".join(changed) + " after" * 20, "before after " * 40]
    assert run(spark, docs, [" ".join(item)]) == {(0, 0): 35}


def test_clean(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r["doc_id"] for r in D.query(spark, sf).collect()}
    kept = D.clean(spark, docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    assert D.clean(spark, docs, bench.limit(0)).count() == docs.count()


def test_masks_ignore_any_places_that_may_differ():
    for n, masks in ((D.SPAN, D.MASKS),):
        for places in itertools.combinations(range(n), n - math.ceil(D.SHARE * n)):
            assert any(all(m[k] == "0" for k in places) for m in masks)


def test_random_substitutions_like_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(5000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items, docs = [make(rng.randint(12, 20)) for _ in range(60)], []
    for it in items:
        for share in (0.05, 0.1, 0.2, 0.25):
            part = [w if rng.random() >= share else rng.choice(vocab) for w in it]
            docs.append(" ".join(make(rng.choice((0, 9))) + part[rng.choice((0, 0, 3)) :] + make(rng.choice((0, 9)))))
    texts = [" ".join(x) for x in items]
    expected = {(j, k): m for j, d in enumerate(docs) for k, t in enumerate(texts) if (m := alike(d, t)) is not None}
    assert len(expected) > 100
    assert run(spark, docs, texts) == expected


def test_short_masks():
    for n in range(D.SHORT, D.SPAN):
        for places in itertools.combinations(range(n), n - math.ceil(D.SHARE * n)):
            assert any(all(m[k] == "0" for k in places) for m in D.masks(n))


def test_short_items_like_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(5000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items, docs = [make(n) for n in range(D.SHORT, D.SPAN) for _ in range(6)], []
    for it in items:
        for off in (1, 2, 3):
            part = list(it)
            for k in rng.sample(range(len(it)), off):
                part[k] = rng.choice(vocab)
            docs.append(" ".join(make(rng.choice((0, 9))) + part[rng.choice((0, 0, 1)) :] + make(rng.choice((0, 9)))))
    texts = [" ".join(x) for x in items]
    expected = {(j, k): m for j, d in enumerate(docs) for k, t in enumerate(texts) if (m := alike(d, t)) is not None}
    assert len(expected) > 40
    assert run(spark, docs, texts) == expected


def test_unsearched(spark):
    items = [" ".join(f"w{k}" for k in range(n)) for n in (4, 5, 1, 30)] + [None, "", "one, two"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r) for r in D.unsearched(bench).collect()} == {(0, 4), (2, 1), (4, 0), (5, 0), (6, 2)}
