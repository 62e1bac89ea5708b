import re

import numpy as np
import pytest
import xxhash

from diurna.llm import common, similar, simhash


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprints(corpus):
    for t in corpus:
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


def test_components(make_docs, corpus):
    ids = [3 * i + 1 for i in range(len(corpus))]
    ids[10], ids[20], ids[21] = None, 4, 4
    got = sorted(map(tuple, simhash.components(make_docs(corpus, ids).withColumnRenamed("lang", "fp"), 4).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    fps = [brute_fingerprint(t) for t in corpus]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], brute_components(ids, fps), strict=True), key=str)
    assert got == want


@pytest.mark.parametrize(("n", "tile", "agree"), [(300, 2048, None), (600, 100, 2), (300, 2048, 3), (300, 50, 4)])
def test_links_of_near_fingerprints(spark, n, tile, agree):
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**64, 3, np.uint64, endpoint=False)
    fps = []
    for i in range(n):
        x = int(centres[i % 3])
        for b in r.choice(64, r.integers(0, 6), replace=False).tolist():
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    rows = [(int(np.array(f, np.uint64).view(np.int64)), i) for i, f in enumerate(fps)]
    e = simhash.links(spark.createDataFrame(rows, "fp long, node long"), 4, tile, agree)
    pairs = e.collect()
    assert all((fps[u] ^ fps[v]).bit_count() <= 4 for u, v in pairs)
    roots = {u: v for u, v in common.connected_components(e).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps)


def test_dedup(make_docs, corpus):
    ids = [2 * i for i in range(len(corpus))]
    docs = make_docs(corpus, ids)
    kept = [r.doc_id for r in simhash.dedup(docs, 4, 4).collect()]
    fps = [brute_fingerprint(t) for t in corpus]
    assert sorted(kept) == [i for i, c in zip(ids, brute_components(ids, fps), strict=True) if i == c]
    assert simhash.dedup(docs).columns == docs.columns
    lone = make_docs(["only without an id", "only without an id", "x y z"], [None, None, 7])
    assert sorted(map(str, (r.doc_id for r in simhash.dedup(lone).collect()))) == ["7", "None"]


def brute_sets(texts, shingle=5):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def brute_similar(ids, texts, threshold=0.8):
    """Smallest id of each text's group, by all pairs."""
    sets, root = brute_sets(texts), list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or n and n / len(sets[i] | sets[j]) >= threshold:
                root[top(i)] = top(j)
    tops = [top(i) for i in range(len(ids))]
    return [min(x for x, t in zip(ids, tops, strict=True) if t == r) for r in tops]


@pytest.mark.parametrize("enough", [0, 100])
def test_dedup_similar(make_docs, monkeypatch, enough):
    monkeypatch.setattr(similar, "ENOUGH", enough)  # 0: by rounds of centres alone
    r = np.random.default_rng(5)
    texts = ["", None, " ", "a b", "A  b", "a b c"]
    for _ in range(6):
        words = [f"w{x}" for x in r.integers(0, 5000, 120)]
        for _ in range(8):  # each further edit from the last: chains whose ends are not similar
            words = list(words)
            for _ in range(int(r.integers(0, 4))):
                words[int(r.integers(0, len(words)))] = "new%d" % r.integers(0, 10**6)
            texts.append(" ".join(words))
    ids = r.permutation(len(texts)).tolist()
    docs = make_docs(texts, ids)
    got = similar.dedup_similar(docs)
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(brute_similar(ids, texts)))


def test_dedup_similar_edges(make_docs):
    assert similar.dedup_similar(make_docs([])).count() == 0
    docs = make_docs(["x y z"] * 3 + ["only without an id", "another", "x  Y z"], [7, 7, 3, None, 7, None])
    got = sorted((str(x.doc_id), x.text) for x in similar.dedup_similar(docs).collect())
    assert got == [("3", "x y z"), ("7", "another"), ("None", "only without an id")]


def test_similar_texts_around_one_passage(make_docs, monkeypatch):
    """One common passage, in texts below and above the threshold; its shingles are frequent."""
    r = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{r.integers(0, 10**9)}" for _ in range(int(r.integers(1, 40)))]) for _ in range(120)]
    ids = list(range(len(texts)))
    want = sorted(set(brute_similar(ids, texts)))
    assert 1 < len(want) < len(texts)
    for hot in (similar.HOT, 0):  # without the list of frequent shingles the work changes, not the result
        monkeypatch.setattr(similar, "HOT", hot)
        assert sorted(x.doc_id for x in similar.dedup_similar(make_docs(texts, ids)).collect()) == want


def test_similar_keeps_clashing_columns(make_docs):
    docs = make_docs(["a b c d e f", "A b c d e f", "x"]).withColumnRenamed("lang", "row").withColumnRenamed("source", "id")
    got = similar.dedup_similar(docs)
    assert got.columns == docs.columns and sorted((x.doc_id, x.row, x.id) for x in got.collect()) == [(0, "en", "s"), (2, "en", "s")]


def test_empty_table(make_docs):
    assert simhash.components(make_docs([])).count() == 0


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components_of_a_long_path_and_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    got = {u: v for u, v in common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1400)}}
