import hashlib
import re

import pytest

from diurna.llm import substring


def brute(rows, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            low[k] = min(d, low.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if low[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(50, 16), (8, 3)])
def test_against_brute_force(make_docs, corpus, window, anchor):
    ids = [(7 * i) % 1009 for i in range(len(corpus))]
    ids[5], ids[11], ids[12] = None, 33, 33
    docs = make_docs(corpus, ids).withColumnRenamed("lang", "path").withColumnRenamed("source", "n_words")
    got = substring.substring_dedup(docs, window, anchor).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(list(zip(ids, corpus, strict=True)), window), key=str)


def test_repetitive_text_and_repeated_rows(make_docs):
    rows = [(1, "a " * 200), (2, "a " * 120 + "b " * 60), (2, "a " * 120 + "b " * 60), (3, "b " * 70), (4, "c a " * 100)]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    got = substring.substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_a_path_is_one_row_of_a_text(make_docs):
    """A word, a word pair and a line that a text repeats: rows by text and path, however often it occurs there."""
    line = " ".join(f"w{i}" for i in range(60)) + "\n"
    rows = [(k, f"{k} " + "a b " * (100 + k)) for k in range(4)] + [(k, "c " * 150 + str(k)) for k in range(4, 7)]
    rows += [(k, line * 5 + f"end of {k}") for k in range(7, 10)] + [(10, "x " + "a b " * 30 + line + "c " * 49 + "a b " * 26 + "y")]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    found = substring.path_rows(docs.selectExpr("doc_id", "xxhash64(text) as row", "text"), 50, 16).collect()
    assert len(found) == len({(r.doc_id, r.row, r.edge, r.path) for r in found})
    for i, t in rows:  # each window is in one of its text's paths
        at = sorted(s + o for r in found if r.doc_id == i for s in (r.start, *(r.again or ())) for o in range(r.n))
        assert at == list(range(len(t.split()) - 49))
    got = substring.substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_words_made_to_collide(make_docs):
    """Words, and runs of words, that are equal under polynomials modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(512)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    around = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*around[:30], word, *around[30:]])) for k, word in enumerate((one, two))]
    rows += [(k + 2, " ".join("ab"[b ^ k] for b in bits)) for k in (0, 1)]
    got = substring.substring_dedup(make_docs([t for _, t in rows], [i for i, _ in rows]), texts=False)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(brute(rows))
    assert got.where("doc_id < 2 and n_removed > 0").count() == 0


def test_equal_hashes_of_other_words_remove_nothing(make_docs, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    span = {"start": 0, "n": 3, "mask": None, "words": substring.digest([w.encode() for w in words[:52]])}
    assert substring._cover([w.encode() for w in words], [span], 50).sum() == 52
    assert not substring._cover([w.upper().encode() for w in words], [span], 50).any()


def test_copies_are_classes(make_docs):
    long, short = " ".join(f"w{i}" for i in range(70)), "a few words"
    rows = [(5, long), (5, long), (9, long), (7, long + " more"), (2, short), (3, short), (None, long), (11, "")]
    got = substring.substring_dedup(make_docs([t for _, t in rows], [i for i, _ in rows]), texts=False)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_table(make_docs):
    assert substring.substring_dedup(make_docs([])).count() == 0


def test_kept_text_and_columns(make_docs):
    long = " ".join(f"w{i}" for i in range(80))
    out = {r.doc_id: r for r in substring.substring_dedup(make_docs([long, "x\n" + long, None])).collect()}
    assert out[0].kept_text == long and out[1].kept_text == "x" and out[2].kept_text is None
    assert out[1].lang == "en" and out[1].text == "x\n" + long
