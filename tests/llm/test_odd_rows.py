"""Null ids, repeated rows, and tables without rows, for the operators whose own tests don't hold them."""

import pytest

from pricelens.llm import decontaminate, license_scan, media, minhash_dedup, packing, secret_scan, token_files
from pricelens.llm.tokens import tokenizer_path

ROWS = [(None, "one two three " * 4), (1, "one two three " * 4), (1, "one two three " * 4), (2, None), (None, None), (3, "x " * 30000)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def by_id(rows):
    return sorted(r["doc_id"] is None and -1 or r["doc_id"] for r in rows)


IDS = sorted(-1 if k is None else k for k, _ in ROWS)


def test_near_duplicates(spark, df):
    got = minhash_dedup.groups(spark, df, shingle=2).collect()
    assert by_id(got) == IDS
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {(1, 1, True), (2, 2, True), (3, 3, True)}
    assert all(r["kept"] for r in got if r["doc_id"] is None and r["n_shingles"] == 0)


def test_packing(spark, df):
    got = packing.pack(spark, df, tokenizer_path("byte_bpe_50k.json")).collect()
    assert by_id([r for r in got if r["piece"] == 0]) == IDS


def test_token_files(spark, df):
    got = token_files.round_trip(spark, df, tokenizer_path("word_bpe_49k.json")).collect()
    assert by_id(got) == IDS
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, None, 1, 1, 2, 3]
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]


def test_media(spark, df):
    stored = media.store(spark, df)
    rows = media.resolve(media.sequences(stored.select("doc_id", "n_bytes", "html")), media.facts(stored)).collect()
    assert by_id(rows) == IDS and all(r["payload_bytes"] % 64 == 0 for r in rows)


def test_scans(spark, df):
    assert by_id(license_scan.scan(df).collect()) == IDS
    assert by_id(secret_scan.find(df).collect()) == IDS


def test_decontamination(spark, df):
    bench = spark.createDataFrame([(None, "one two three one two three"), (7, "one two three one two three"), (8, None)], "item_id long, text string")
    got = decontaminate.find(spark, df, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in got) == sorted((d, i) for d in (-1, 1, 1) for i in (-1, 7))
    assert decontaminate.find(spark, df.limit(0), bench).count() == 0
