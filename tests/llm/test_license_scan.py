import random
import re

from pricelens.llm import license_scan as L

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


CASES = [
    None,
    "",
    "... !!!",
    "Licensed under the Apache License, Version 2.0. Apache license",
    "GNU General Public License gnu general public license, version 3; cc by-nc 4.0",
    "ÉMIT license mit License MITlicense mit é license",
    "gnu gnu general public license general",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit und mit",
    "license",
]


def test_base_places(spark):
    rows = spark.createDataFrame([(k, t, 5) for k, t in enumerate(CASES)], "doc_id long, text string, labels int")
    for r in L.scan(rows).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(CASES[r["doc_id"]]), r
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    got = {r["doc_id"]: r["labels"] for r in L.scan(rows).collect()}
    assert got[3] == "apache,apache-2.0" and got[7] == "mit" and "gpl-3" in got[4] and "cc-by-nc" in got[4]


MIT, ZLIB = (next(t for t in L.TEXTS if t.label == label).words for label in ("mit", "zlib"))


def test_longer_templates(spark):
    words = MIT.split()
    changed = " ".join("x" if k in (0, 30, 60, 61) else w for k, w in enumerate(words))
    broken = ZLIB.replace("be held liable", "be made liable")
    rows = [(1, MIT.upper()), (2, "intro words here " + changed + " more"), (3, broken), (4, " ".join(ZLIB.split()[:20])), (5, " ".join(reversed(words)))]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["base_labels"] == ""
    assert got[2]["labels"] == "mit" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "" and 0.9 < got[3]["score"] < 1
    assert got[4]["labels"] == "" and got[5]["labels"] == ""


def test_each_template_finds_itself(spark):
    rows = [(k, "some " + t.words + " other") for k, t in enumerate(L.TEMPLATES)]
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert L.TEMPLATES[r["doc_id"]].label in r["labels"].split(",")


def aligned(text):
    """Labels and score by testing every template at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    labels, best = set(), 0.0
    for e in L.index():
        for i in range(len(words)):
            hit = [i + k < len(words) and words[i + k] == w for k, w in enumerate(e.words)]
            if sum(hit[k] for k in e.rare) < e.need:
                continue
            share = sum(x for h, x in zip(hit, e.idf, strict=True) if h) / sum(e.idf)
            best = max(best, share)
            if share >= e.template.least and all(all(hit[at : at + len(p)]) for at, p in e.phrases):
                labels.add(e.template.label)
    return ",".join(sorted(labels)), 1.0 if labels else round(best, 6)


def test_like_every_template_at_every_word(spark):
    rng = random.Random(2)
    pool = [t.words.split() for t in L.TEMPLATES]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            part = list(rng.choice(pool))
            part = [rng.choice(("the", "license", "gnu", w)) if rng.random() < 0.05 else w for w in part]
            w += part[rng.randint(0, 2) :]
        texts.append(" ".join(w))
    texts += ["license " * 3000 + "gnu " * 2000, "gnu general public license " * 500]
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {k: aligned(t) for k, t in enumerate(texts)}


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([(1, "mit license " * 50_000 + "x " * 200_000)], "doc_id long, text string")
    r = L.scan(df).first()
    assert (r["n_words"], r["n_base"], r["last_word"]) == (300_000, 50_000, 99_998)
    assert L.scan(df.limit(0)).count() == 0


def test_query_on_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in L.query(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
