import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.llm import chat, packing, tokens
from diurna.llm.queries import BYTE_BPE, pack_tokens, tokenizer_path


def test_best_fit_is_sound():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 8193, 500)
    bins, starts, final = packing.best_fit(lengths)
    for b in range(len(final)):
        inside = np.flatnonzero(bins == b)
        spans = sorted((starts[i], starts[i] + lengths[i]) for i in inside)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(spans))
        used = spans[-1][1]
        assert final[b] == min(c for c in packing.CAPACITIES if c >= used)
    # descending best fit needs at most 11/9 of the fewest bins, and 4 more
    fewest = max(-(-lengths.sum() // 8192), (lengths > 4096).sum())
    assert (final == 8192).sum() <= 11 / 9 * fewest + 4


def cost(final, overhead=packing.OVERHEAD, attention=packing.ATTENTION):
    return sum(packing.price(int(c), overhead, attention) for c in final)


def test_sizes_are_chosen_jointly():
    r = np.random.default_rng(2)
    mixes = {"short": r.integers(1, 500, 2000), "any": r.integers(1, 8193, 2000), "log-normal": np.clip(r.lognormal(6, 1.2, 2000), 1, 8192).astype(int)}
    for name, lengths in mixes.items():
        bins, _, final = packing.best_fit(lengths)
        alone = [packing.best_fit(lengths, (8192,))[2]]
        used = np.bincount(bins, lengths)
        single = np.array([min(c for c in packing.CAPACITIES if c >= u) for u in np.bincount(packing.best_fit(lengths, (8192,))[0], lengths)])
        assert cost(final) <= cost(single) and len(final) >= len(alone[0])
        assert (used <= final).all() and 1 - used.sum() / final.sum() < 0.02
        if name == "log-normal":
            assert len(np.unique(final)) == 5 and np.unique(final, return_counts=True)[1].min() > 20


def test_small_cases_are_near_the_best():
    r = random.Random(1)
    ratios = []
    for _ in range(60):
        lengths = [r.randint(1, 16) for _ in range(5)]
        best = min(
            cost([min((c for c in (4, 8, 16) if c >= sum(g)), default=10**6) for g in groups], 1, 16)
            for groups in ([[x for x, b in zip(lengths, assign, strict=True) if b == k] for k in set(assign)] for assign in itertools.product(range(5), repeat=5))
        )
        ratios.append(cost(packing.best_fit(np.array(lengths), (4, 8, 16), 1, 16)[2], 1, 16) / best)
    assert 1 <= min(ratios) and max(ratios) <= 1.1 and np.mean(ratios) < 1.01


def test_pack(make_docs, corpus):
    texts = [*corpus, "w " * 20000, "w " * 20000]
    ids = list(range(len(texts)))
    ids[2], ids[3] = None, 4
    docs = make_docs(texts, ids).withColumnRenamed("lang", "n").withColumnRenamed("source", "part")
    words = F.size(F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"))
    rows = packing.pack(docs, F.when(F.length("text") > 0, words + 1), group=16).collect()
    total = sum(r.length for r in rows)
    assert total == sum(len((t or "").encode().split()) + 1 if t else 0 for t in texts)
    by = {}
    for r in rows:
        if r.length:
            by.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_start, r.bin_start + r.length))
        else:
            assert r.bin_id is None
    assert len({b for b, _ in by}) == len(by)
    for (_, capacity), spans in by.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
    long = sorted((r.piece_start, r.length) for r in rows if r.doc_id == len(texts) - 1)
    assert long == [(0, 8192), (8192, 8192), (16384, 20001 - 16384)]
    assert packing.pack(make_docs([]), F.length("text")).count() == 0


def test_packed_lengths_are_tokens(make_docs, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    docs = make_docs(corpus)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 if t else 0 for i, t in enumerate(corpus)}
    assert {r.doc_id: r.n_tokens for r in tokens.lengths(docs, tokenizer_path(BYTE_BPE)).collect()} == want
    got = {}
    for r in pack_tokens(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def brute_cost(roles):
    """The least cost by search over every legal rendering: each turn is merged or stands, under any role, behind 0 to 2 empty turns."""
    names = ("system", "user", "assistant")

    def search(k, last):
        if k == len(roles):
            if last == "assistant":
                return 0.0
            return min(2.0 + search(k, x) for x in LEGAL[last])
        best = 1e9
        for name in names:
            change = 0.0 if name == roles[k] else 3.0
            if name == last:
                best = min(best, change + 1.0 + cached(k + 1, name))
            for n in range(3):
                for way in itertools.product(names, repeat=n):
                    path = [last, *way, name]
                    if all(b in LEGAL[a] for a, b in itertools.pairwise(path)):
                        best = min(best, change + 2.0 * n + cached(k + 1, name))
        return best

    known = {}

    def cached(k, last):
        if (k, last) not in known:
            known[k, last] = search(k, last)
        return known[k, last]

    return cached(0, "")


def legal(roles):
    roles = roles[1:] if roles and roles[0] == "system" else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


@pytest.mark.parametrize("segment", [1024, 3])
def test_chat(spark, segment):
    r = random.Random(2)
    rows, expect = [], {}
    for conv in range(40):
        n = r.randint(1, 12)
        roles = [r.choice(["user", "assistant", "system", "tool", "User ", None]) for _ in range(n)]
        rows += [(conv, t, x, f"{conv}.{t}") for t, x in enumerate(roles)]
        expect[conv] = ([chat.clean(x) for x in roles], [f"{conv}.{t}" for t in range(n)])
    rows += [(None, 0, "user", "lost"), (99, None, "user", None), (99, 0, "assistant", "x")]
    out = {}
    for x in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment).orderBy("conv_id", "segment").collect():
        o = out.setdefault(x.conv_id, [0.0, [], ""])
        o[0] += x.cost
        o[1] += x.roles
        o[2] += x.rendered
    assert set(out) == {*expect, 99}
    assert out[99][2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    for conv, (roles, texts) in expect.items():
        cost, rendered, text = out[conv]
        assert cost == brute_cost(roles)
        assert legal(rendered) and text.count("<|im_start|>") == len(rendered) == text.count("<|im_end|>")
        at = [text.index(t) for t in texts]
        assert at == sorted(at)


def test_one_turn_number_and_very_long_turns(spark):
    """A conversation whose rows share a turn number is cut by rows, and long texts are whole."""
    rows = [(1, 7, "user", "x" * 300_000 + str(i)) for i in range(20)] + [(2, None, "assistant", str(i)) for i in range(9)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 4).orderBy("conv_id", "segment").collect()
    one = [r for r in got if r.conv_id == 1]
    assert len(one) >= 5 and all(r.n_turns <= 4 for r in got) and sum(r.n_turns for r in one) == 20
    assert sum(len(r.rendered) for r in one) > 20 * 300_000 and sum(r.cost for r in one) == 19 * chat.MERGE + chat.INSERT


def test_kept_conversation_is_unchanged(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.cost == 0 and got.n_changed == 0
    assert got.rendered == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_no_conversations(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repeated_turns_and_extra_columns(spark):
    rows = [(1, 0, "user", "u", 5), (1, 0, "user", "u", 6), (1, 1, "assistant", None, 7)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")).first()
    assert got.n_turns == 3 and got.cost == chat.MERGE and got.rendered.startswith("<|im_start|>user\nu\n\nu<|im_end|>")
