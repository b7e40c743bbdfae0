import corpus_pipeline as C
from pricelens.llm.secret_scan import find

from .test_minhash_dedup import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    first = docs
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = C.written(spark, stage(spark, docs, sf), name)
        assert docs.columns == names
        kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(kept["language_id"]) == first.count()
    groups = brute(sorted(kept["language_id"].items()), 5)
    assert set(kept["near_duplicates"]) == {k for k, (_, _, keep) in groups.items() if keep}
    assert set(kept["benchmark_overlaps"]) < set(kept["near_duplicates"])
    assert set(kept["secrets"]) == set(kept["benchmark_overlaps"])
    assert find(docs.select("doc_id", "text")).filter("size(secrets) > 0").count() == 0
    packed = C.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(kept["secrets"])


def test_language_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [
        (10**6, "12 34 !!", "en", "s", 8),
        (10**6 + 1, None, None, None, None),
        (10**6 + 2, "xqzv wjkpq zzvxk qjwvz " * 20, "en", "s", 1),
        (10**6 + 3, "Съешь же ещё этих мягких французских булок " * 9, None, "s", 1),
    ]
    mixed = (10**6 + 4, " ".join(r["text"] for r in docs.dropDuplicates(["lang"]).collect()), None, "s", 1)
    got = C.languages(spark, docs.union(spark.createDataFrame([*odd, mixed], docs.schema)), sf)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()} | {mixed[0]}
    only = C.languages(spark, docs, sf, frozenset({"de"})).groupBy("lang").count().collect()
    assert [r["lang"] for r in only] == ["de"]


def test_language_stage_without_labels(spark, sf):
    docs = spark.createDataFrame([(1, "two english rows", None), (2, "without a label", None), (3, "...", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in C.languages(spark, docs, sf).collect()} == {1, 2}
    assert C.languages(spark, docs.limit(0), sf).count() == 0


def test_language_stage_learns_from_every_labelled_row(spark, sf, monkeypatch):
    """The stage's model and floor are those of all 3,000 labelled rows that aren't held out."""
    one = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = one.selectExpr("explode(sequence(0, 39)) k", "*").selectExpr("doc_id + 1000000 * k doc_id", "substr(text, 1 + 20 * k, 60 + 10 * k) text", "lang").coalesce(1)
    own = [r for r in docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(~C.language_id.held_out(docs.doc_id)).collect()]
    assert len(own) > 3_000 and max(sum(r["lang"] == k for r in own) for k in {r["lang"] for r in own}) > 1_000
    seen = []
    keep = C.language_id.select_languages
    monkeypatch.setattr(C.language_id, "select_languages", lambda s, d, model, **k: seen.append(model) or keep(s, d, model, **k))
    C.languages(spark, docs, sf)
    (model,) = seen
    texts = [r["text"] for r in own]
    real, mixed = (model.evidence(f(texts)[0]).mean(dtype="float64") for f in (C.language_id.grams, C.language_id.shuffled))
    want = (1 - C.language_id.FLOOR) * real + C.language_id.FLOOR * mixed
    assert abs(model.floor - want) < 0.02  # letters are dealt anew within slices
