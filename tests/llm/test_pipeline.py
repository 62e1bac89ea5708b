import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from diurna.llm import common, quality, toxicity
from diurna.llm.queries import BYTE_BPE, tokenizer_path

from .test_simhash import brute_similar
from .test_substring import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_against_brute_force(spark):
    docs = common.read_table(spark, DATA, "documents")
    labels = common.read_table(spark, DATA, "labels")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:2]:
        before = {r.doc_id for r in docs.collect()}
        model = toxicity.classify(docs, labels) if name == "toxicity" else quality.classify(docs, labels)
        want = {r.doc_id for r in model.collect() if r.predicted == (0 if name == "toxicity" else 1)}
        docs = common.stored(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] == want and want <= before
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    docs = common.stored(corpus_pipeline.drop_near_copies(spark, docs, DATA), "test")
    roots = brute_similar([d for d, _ in rows], [t for _, t in rows])
    rows = [r for r, c in zip(rows, roots, strict=True) if r[0] == c]
    assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    want = {d: (n, gone) for d, n, gone, _ in brute(rows)}
    docs = common.stored(corpus_pipeline.cut_repeats(spark, docs, DATA), "test")
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(got) == {d for d, (n, gone) in want.items() if gone < n or not n}
    for d, t in rows:
        if d in got:
            n, gone = want[d]
            assert got[d].text == t if not gone else len(got[d].text.encode().split()) == n - gone
    packed = corpus_pipeline.pack(spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == set(got)
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    assert sum(r.length for r in packed) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 if r.text else 0 for r in got.values())


def test_run_equals_the_stages(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "length").collect())) for _ in range(2))
    assert a == b and a


def test_stages_on_nulls_and_nothing(spark, make_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (make_docs([]), make_docs([None, "", "a b c", "a b c"], [None, 1, 2, 2])):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
        docs.collect()


def test_clashing_columns_pass_all_stages_but_the_last(spark, make_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    words = " ".join(f"w{i}" for i in range(90))
    docs = make_docs([words, "x " + words + " " + " ".join(f"v{i}" for i in range(60)), None])
    for name in ("score", "predicted", "n_words", "n_removed", "kept_sha256", "kept_text", "id", "row", "spans"):
        docs = docs.withColumn(name, docs.doc_id * 7.5)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns
        assert all(r[c] == r.doc_id * 7.5 for r in docs.collect() for c in columns[5:])
    assert docs.count() == 3 and docs.where("doc_id = 1").first().text.startswith("x")
