"""The stages, each against its operator's brute-force meaning on the rows before it."""

import collections

import corpus_pipeline as pipeline
from strandkv.llm import pii
from strandkv.llm.queries import QUERIES

from ..conftest import SF
from .test_operators import jaccard_brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before = {r.doc_id: r for r in docs.collect()}
    one = pipeline.quality_rules(spark, docs, SF).cache()
    kept = {r.doc_id for r in QUERIES["op10_quality_rules"](spark, SF).collect() if r.kept}
    rows = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns and set(rows) == kept
    assert all(set(r.text.split("\n")) <= set(before[i].text.split("\n")) and r.n_chars == len(r.text) for i, r in rows.items())

    twice = one.union(one.limit(3)).cache()  # repeated rows
    two = pipeline.exact_dedup(spark, twice, SF).cache()
    best = {}
    for r in twice.collect():
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert collections.Counter(r.doc_id for r in two.collect()) == collections.Counter(best.values())

    three = pipeline.near_dedup(spark, two, SF).cache()
    want = {c for (_, _, c) in jaccard_brute([(r.doc_id, r.text) for r in two.collect()], 5, 80)}
    assert {r.doc_id for r in three.collect()} == want and three.count() == len(want)

    four = pipeline.mask_personal_data(spark, three, SF).cache()
    tagger = pii.trained()
    texts = {r.doc_id: r.text for r in three.collect()}
    _, spans = pii.find(list(texts.values()), tagger)
    assert four.columns == docs.columns and {r.doc_id: r.text for r in four.collect()} == {i: pii.mask(t, s) for (i, t), s in zip(texts.items(), spans)}

    five = pipeline.best_fit_packing(spark, four, SF).toPandas()
    assert set(five.doc_id) == want and five.groupby("sequence_id").length.sum().max() <= 4096


def test_near_dedup_of_repeated_and_null_ids(spark):
    one, two, far = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(5, one), (9, one + " x"), (9, far), (5, two), (3, two + " x"), (None, one + " y"), (None, "d " * 9), (None, far + " x"), (7, far + " y"), (7, far + " y"), (1, "e f"), (1, "e f")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, SF).collect())
    assert got == collections.Counter([(5, one), (7, far + " y"), (3, two + " x"), (None, "d " * 9), (1, "e f")])


def test_names():
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mask_personal_data", "best_fit_packing"]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_rows_pass_through_all_stages(spark):
    """Null and empty texts, null and repeated ids, a very long text, columns with clashing names."""
    prose = lambda seed, n: " ".join(f"{seed}w{(seed * 31 + k * 7919) % 100003}" for k in range(n))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, prose(1, 80), "en", "a", 1), (3, prose(2, 80), None, "b", 2), (3, prose(2, 80), None, "b", 2), (3, prose(3, 90), "en", None, 3), (4, prose(4, 90_000), "en", "a", 4), (5, prose(2, 80) + " more", "en", "b", 5), (6, prose(5, 80) + " call +1 (743) 555-3824", "en", "b", 6)]
    docs = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], KIND + ", kept string, _own int, clean_text string")
    for name, step in pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        got = docs.collect()
        assert docs.columns == list(pipeline.COLUMNS), name
        # an added word or two changes too little: the copy of least id stays, and of repeated rows one
        texts = {"quality_rules": 7, "exact_dedup": 6, "near_dedup": 5, "mask_personal_data": 5}[name]
        assert len(got) == texts, name
        docs = docs.withColumns({"_n": docs.doc_id, "_p": docs.text, "spans": docs.text})
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 3), (False, 3), (False, 4), (False, 6), (True, 0)]
    assert next(r.text for r in got if r.doc_id == 6).endswith("call <PHONE>")
    packed = pipeline.best_fit_packing(spark, docs, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and packed.length.sum() > 90_000


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for _, step in pipeline.STAGES:
        docs = step(spark, docs, SF).cache()
        assert docs.count() == 0
