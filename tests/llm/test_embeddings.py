import numpy as np
import pytest

from diurna.llm import embeddings, topk

ROWS = "vec_id long, embedding array<float>, label int"


def brute_links(rows, t=0.98):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n = {}
    edge = []
    for i, a in enumerate(ok):
        for j, b in enumerate(ok):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    n[i] = n.get(i, 0) + 1
                    edge.append((a[0], b[0]))
    root = {r[0]: r[0] for r in ok}
    changed = True
    while changed:
        changed = False
        for u, v in edge:
            low = min(root[u], root[v])
            if root[u] != low or root[v] != low:
                root[u] = root[v] = low
                changed = True
    out = [(r[0], n.get(i, 0), root[r[0]], r[0] == root[r[0]]) for i, r in enumerate(ok)]
    out += [(r[0], 0, r[0], True) for r in rows if not any(r is o for o in ok)]
    return sorted(out, key=str)


def vectors(n=260, d=40, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = (centres[i % 12] + r.normal(size=d) * (0.12 if i % 3 else 2)).astype(np.float32).tolist()
        rows.append((i, v, i % 12 % 3))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(2000, [0.0] * d, 1), (2001, None, 1), (2002, rows[0][1], None), (None, rows[0][1], 0), (2003, [None] + [1.0] * (d - 1), 1), (2004, [float("nan")] * d, 1), (2005, [float("inf")] + [1.0] * (d - 1), 1), (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [1e-30] * d, 2), (2010, [1e30] * d, 2)]
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_near_duplicates(spark, tile):
    rows = vectors()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, ROWS), 0.98, tile)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


def test_clashing_column_names(spark):
    rows = [(*r, 1, 2, 3) for r in vectors(120)]
    v = spark.createDataFrame(rows, ROWS + ", cell int, q int, part int")
    assert sorted(map(tuple, embeddings.near_duplicates(v, 0.98).collect()), key=str) == brute_links([r[:3] for r in rows])
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect())) == brute_top([r[:3] for r in rows])


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
    assert topk.top_k(v := spark.createDataFrame([], ROWS), v).count() == 0


def brute_top(rows, k=5):
    ok = [(r[0], np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(object)) for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, q in {i: q for i, q in ok if i % 50 == 0}.items():
        best = sorted((-int(sum(q * v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile"), [(16384, 8192), (37, 3)])
def test_top_k(spark, block, tile):
    rows = vectors() + [(2012, [1e30] * 20 + [-3e30] * 20, 1), (4000, [1e30] * 40, 2), (4050, [3.4e38] * 39 + [-3.4e38], 2), (4051, [5e16] * 40, 2)] + [(3000 + i, [0.0] * 40, 0) for i in range(3)] + [(5000, [0.1, 3.0], 1)]
    v = spark.createDataFrame(rows, ROWS)
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0"), 5, 256, block, tile).collect())) == brute_top(rows)


def test_large_components_stay_exact():
    ids = np.arange(50)
    rows = np.random.default_rng(0).integers(-(1 << 28), 1 << 28, (50, 8))
    lists = topk.Lists(ids, rows)
    got, scores = lists.top(3, rows[3].astype(float), 5)
    want = sorted((-int(sum(int(a) * int(b) for a, b in zip(rows[3], v, strict=True))), i) for i, v in enumerate(rows) if i != 3)[:5]
    assert [(-s, i) for i, s in zip(got.tolist(), scores.tolist(), strict=True)] == want
