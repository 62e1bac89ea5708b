import zlib

import numpy as np
import pytest

from diurna.llm import common, pieces, tokens
from diurna.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_path

ODD = ["", " ", "  ", "a  b", "a   b", " a", "a ", "\n a \n", "a\n b", "a \nb", "a \n b", "  \t x", "x y  z", "don't we'll I'm 'tis", "<|endoftext|> a<|endoftext|> <|endoftext|>b", "é 😀   q", "1 23 4,5", "a\x1cb \x1c c", "▁ ▁a", "\x00 a\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_segments_encode_as_whole_texts(corpus, library):
    code = tokens.Encoder(tokenizer_path(BYTE_BPE))
    texts = ODD + [t for t in corpus if t is not None]
    for _ in range(2):
        got = [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)]
        assert got == [library(t) for t in texts]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode_all(texts)] == got


def test_files(spark, make_docs, corpus, library):
    texts = ODD + corpus
    ids = [(13 * i) % 1009 for i in range(len(texts))]
    ids[4], ids[6], ids[7] = None, 50, 50
    folder = common.scratch(spark, "test")
    manifest = tokens.write(make_docs(texts, ids), folder, tokenizer_path(BYTE_BPE), 0, parts=3)
    got = sorted(map(tuple, tokens.read(spark, manifest, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got if r[0] is not None] == sorted(i for i in ids if i is not None)
    assert got[0][0] is None
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    want = sorted((str(i), len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in zip(ids, [library(t or "") for t in texts], strict=True))
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == want
    names = [r.name for r in manifest.orderBy("part").collect()]
    flat = np.concatenate([tokens.Part(folder, n).ids for n in names])
    assert len(flat) == sum(r[2] for r in got)
    first = min((i, k) for k, i in enumerate(ids) if i is not None and ids.count(i) == 1)
    row = next(r for r in got if r[0] == first[0])
    assert flat[row[1] : row[1] + row[2]].tolist() == [*library(texts[first[1]] or ""), 0]


def test_reading_by_ranges_equals_the_map(spark, make_docs, corpus, tmp_path, monkeypatch):
    from pyarrow import fs

    docs = make_docs(corpus).withColumnRenamed("lang", "part").withColumnRenamed("source", "h")
    folder = str(tmp_path)
    manifest = tokens.write(docs, folder, tokenizer_path(BYTE_BPE), 0, parts=2)
    for name in [r.name for r in manifest.collect()]:
        mapped = tokens.Part(folder, name)
        with monkeypatch.context() as m:
            m.setattr(tokens, "_open", lambda f: (fs.SubTreeFileSystem(f, fs.LocalFileSystem()), ""))  # not a local file system
            ranged = tokens.Part(folder, name)
        assert ranged.file is not None and not hasattr(ranged, "ids")
        for a, b in ((0, len(mapped)), (3, 4), (1, 9), (5, 5)):
            assert np.array_equal(mapped.documents(a, b), ranged.documents(a, b))


def test_no_documents(spark, make_docs):
    folder = common.scratch(spark, "test")
    assert tokens.read(spark, tokens.write(make_docs([]), folder, tokenizer_path(BYTE_BPE)), folder).count() == 0


def test_pieces_equal_the_library(corpus):
    m = pieces.Model(tokenizer_path(PIECE_BPE))
    texts = ODD + [t for t in corpus if t is not None] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "                     x", "thethethethethe the"]
    got = [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)]
    assert got == [m.sp.encode(t) for t in texts]
    table = pieces.decode_table(m)
    back = [pieces.decode_fast(m, table, np.array(i)) for i in got]
    assert back == [t.replace("▁", " ") for t in texts]


def test_best_sum_is_the_best():
    m = pieces.Model(tokenizer_path(PIECE_BPE))
    segments = ["▁abacus", "▁the", "inner", "▁relations"]
    for s, row in zip(segments, m.relax_best_sum(segments), strict=True):
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            for a in range(e):
                i = m.sp.piece_to_id(s[a:e])
                if i != m.sp.unk_id():
                    best[e] = max(best[e], best[a] + m.score[i])
        assert sum(m.score[i] for _, _, i in row) == best[-1]
        assert "".join(s[a : a + n] for a, n, _ in row) == s


def test_suffix_array():
    r = np.random.default_rng(0)
    codes = r.integers(0, 3, 200).astype(np.int32)
    order = pieces.suffix_array(codes, 16)
    keys = [codes[i : i + 16].tolist() for i in order]
    assert keys == sorted(keys)


def test_encode_and_decode_frames(make_docs):
    docs = make_docs(["a b", None, "", "  two  spaces "])
    rows = pieces.encode(docs, tokenizer_path(PIECE_BPE))
    assert [(r.n_tokens > 0, r.round_trip) for r in rows.orderBy("doc_id").collect()] == [(True, True), (False, True), (False, True), (True, True)]
    assert [r.text for r in pieces.decode(rows, tokenizer_path(PIECE_BPE)).orderBy("doc_id").collect()] == ["a b", "", "", "  two  spaces "]
    assert pieces.encode(make_docs([]), tokenizer_path(PIECE_BPE)).count() == 0
