import random
import zlib

import numpy as np

from diurna.llm import quality, toxicity


def labelled(make_docs, spark, n=500):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(30, 90))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["idiot", "zzort" + r.choice(vocab), "qqmal" + r.choice(vocab)])
        texts.append(" ".join(words))
        labels.append((i, int(not bad), int(toxic)))
    texts += [None, "", "word " * 30000]
    docs = make_docs(texts).withColumnRenamed("lang", "score")
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (0, None, 7)], "doc_id long, quality int, toxic int"), labels


def accuracy(rows, truth):
    rows = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [i for i in truth if rows[i].held_out]
    assert len(held) > 50
    return np.mean([rows[i].predicted == truth[i] for i in held])


def test_quality(spark, make_docs):
    docs, labels, truth = labelled(make_docs, spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 503
    assert accuracy(rows, {i: q for i, q, _ in truth}) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_linear_time_identity():
    m = quality.Machine(50, 4)
    r = np.random.default_rng(0)
    m.w, m.v, m.b = r.normal(size=50), r.normal(size=(50, 4)), 0.3
    at, x = np.arange(5, 20), r.normal(size=15)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(15) for j in range(i))
    assert np.isclose(m.margin(at, x), 0.3 + m.w[at] @ x + pairs)


def test_toxicity(spark, make_docs):
    docs, labels, truth = labelled(make_docs, spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 503
    assert accuracy(rows, {i: t for i, _, t in truth}) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and 0 < clean.count() < 503


def test_held_out_labels_are_not_learned(spark, make_docs):
    docs, labels, truth = labelled(make_docs, spark, 200)
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in truth], "doc_id long, quality int, toxic int")
    clean = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    for f in (quality.classify, toxicity.classify):
        assert sorted(f(docs, clean).collect(), key=str) == sorted(f(docs, flipped).collect(), key=str)


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(["you idiot you moron", "a fine day", None])
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 3
    assert [r.predicted for r in toxicity.classify(docs, none).orderBy("doc_id").collect()] == [1, 0, 0]
    for f in (quality.classify, toxicity.classify):
        assert f(make_docs([]), none).count() == 0


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    y = r.random(6000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.75, 0.9, 0.85])
    v = np.stack([np.where(r.random(6000) < p, np.where(y, 1, -1), np.where(y, -1, 1)) for p in right], axis=1).astype(np.float32)
    v[:, 4] = v[:, 0]  # a copy: fully correlated
    v[r.random(v.shape) < 0.2] = 0
    p, voters = toxicity.label_model(v)
    assert ((p > 0.5) == y).mean() > 0.9
    assert np.allclose(voters.accuracy, right, atol=0.04)
    assert voters.strength[0] < 0.7 and voters.strength[4] < 0.7 and (voters.strength[[1, 2, 3, 5]] > 0.8).all()


def test_each_term_is_a_voter(spark, make_docs):
    docs, labels, _ = labelled(make_docs, spark)
    model = toxicity.train(docs, labels)
    assert len(model.terms) == len(model.weights) > 1 and len(model.voters.accuracy) == len(model.terms) + len(toxicity.PATTERNS) + 1


def test_own_columns_of_clashing_names_stay(spark, make_docs):
    docs, labels, _ = labelled(make_docs, spark, 200)
    docs = docs.withColumn("score", docs.doc_id * 7.0).withColumnRenamed("source", "predicted")
    for f in (quality.keep_good, toxicity.keep_clean):
        got = f(docs, labels)
        assert got.columns == docs.columns and all(x.score == (None if x.doc_id is None else x.doc_id * 7.0) and x.predicted == "s" for x in got.collect())


def brute_margin(m, text, n_chars):
    """The machine's sum over all pairs, from features built here."""
    at, x = quality.featurize(text, n_chars)
    return m.b + sum(m.w[i] * v for i, v in zip(at, x)) + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))


def test_quality_scores_by_all_pairs(spark, make_docs):
    docs, labels, _ = labelled(make_docs, spark, 120)
    machine = quality.train(docs, labels)
    want = {r.doc_id: 1 / (1 + np.exp(-brute_margin(machine, (r.text or "").encode(), r.n_chars))) for r in docs.where("doc_id < 10").collect()}
    got = {r.doc_id: r.score for r in quality.score(docs.where("doc_id < 10"), machine, ["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)
