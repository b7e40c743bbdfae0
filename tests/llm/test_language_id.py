import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import language_id as L


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    for r in got:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(out) > 100 and sum(out) / len(out) > 0.97


def test_edges(spark):
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("no label", None), ("", "de"), ("le chat", "fr")]
    model = L.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("de", "en", "fr")
    texts = ["the dog", "die katze", None, "", "123 !!", "THE CAT", "☃", "日本"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id int, text string, score int")
    got = [r["lang_pred"] for r in sorted(L.identify(spark, df, model).collect())]
    assert got[:7] == ["en", "de", "und", "und", "und", "en", "und"] and got[7] != "und"
    none = L.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in L.identify(spark, df, none).collect()} == {"und"}


def test_model_ignores_other_columns(spark):
    a = L.grams(["Straße é1"])
    b = L.grams(["straße É2", "x"])
    assert (a[0] == b[0][: len(a[0])]).all()


def log_likelihoods(model_rows, text):
    """Multinomial naive Bayes over the hashed grams, by counting in dictionaries."""
    counts = {}
    for t, lang in model_rows:
        own = counts.setdefault(lang, [Counter(), Counter()])
        for pair in L.grams([t])[0].tolist():
            for k in (0, 1):
                own[k][pair[k]] += 1
    docs = Counter(lang for _, lang in model_rows)
    out = {}
    for lang, own in counts.items():
        total = math.log(docs[lang] / sum(docs.values()))
        for pair in L.grams([text])[0].tolist():
            for k in (0, 1):
                total += math.log((own[k][pair[k]] + 0.5) / (sum(own[k].values()) + 0.5 * L.BUCKETS))
        out[lang] = total
    return out


def test_like_brute_force_bayes(spark):
    rows = [("the cat and the dog sat there", "en"), ("where is the other one", "en"), ("der hund und die katze", "de"), ("wo ist das andere", "de"), ("le chat et le chien", "fr")]
    model = L.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["the hund", "chat", "wo the le", "andere cat", "xyzzy", "le", "tie", "Katze! Katze?"]
    got, _ = model.predict(texts)
    for text, lang in zip(texts, got, strict=True):
        want = log_likelihoods(rows, text)
        assert want[lang] >= max(want.values()) - 1e-3, (text, want)


def test_ties_repeats_null_ids_and_empty_tables(spark):
    model = L.train(spark.createDataFrame([("aba", "b"), ("aba", "a")], "text string, lang string"))
    df = spark.createDataFrame([(None, "aba", "x"), (1, "aba", "y"), (1, "aba", "y"), (2, "zz " * 40_000, "z")], "doc_id long, text string, lang_pred string")
    got = L.identify(spark, df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r["doc_id"] or -1, r["lang_pred"]) for r in got.collect()) == [(-1, "a"), (1, "a"), (1, "a"), (2, "a")]
    assert L.identify(spark, df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        L._sizes(spark.range(3).selectExpr("cast(id as string) lang"), most=2)


def test_recognised(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(~L.held_out(F.col("doc_id"))).select("text", "lang")
    model = L.calibrated(known, L.train(known), 50)
    good = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(L.held_out(F.col("doc_id"))).collect()]
    assert model.recognised(good)[1].all()
    rng = random.Random(1)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), "Привет как дела сегодня " * 20, "日本語の文章" * 40, "12 !!", None]
    mean, ok = model.recognised([*odd, "short"])
    assert ok.tolist() == [False] * 5 + [True] and np.isnan(mean[3]) and np.isnan(mean[4])


def test_learns_from_every_labelled_row(spark):
    """Counts of 6,000 rows of a language and a floor of 7,500 rows are those of all of them."""
    rows = [(" ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for w in ("ka", "lo", "mi")), "x") for k in range(6_000)] + [(f"ze{chr(97 + k % 26)} un{chr(97 + k // 26 % 26)}", "y") for k in range(1_500)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    model = L.train(df)
    for j, lang in enumerate(("x", "y")):
        cells, _ = L.grams([t for t, own in rows if own == lang])
        counts = np.bincount(cells.reshape(-1), minlength=2 * L.BUCKETS) + 0.5
        want = np.concatenate([np.log(c / c.sum()) for c in (counts[: L.BUCKETS], counts[L.BUCKETS :])])
        assert np.allclose(model.log[:, j], want, atol=1e-5)
    texts = [t for t, _ in rows]
    real, mixed = (model.evidence(f(texts)[0]).mean(dtype=np.float64) for f in (L.grams, L.shuffled))
    assert abs(L.calibrated(df, model).floor - ((1 - L.FLOOR) * real + L.FLOOR * mixed)) < 1e-2
