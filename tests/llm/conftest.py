import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty and null ones, and one very long one."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 8))) for _ in range(400)]

    def text(n):
        return " ".join(r.choice(vocab) for _ in range(n))

    base = [text(r.randint(1, 300)) for _ in range(40)]
    passage = text(70)
    near = [" ".join(w if r.random() > 0.01 else "X" for w in base[3].split(" ")) for _ in range(8)]
    shared = [text(20) + "\n" + passage + " " + text(15) for _ in range(6)] + [passage + passage[: len(passage) // 2]]
    odd = ["", None, "  ", " a  b \n\n c\t", "one", "a " * 130, " x  y", text(9000), passage]
    return base + base[:7] + near + shared + odd + [base[0].upper(), base[1].replace(" ", "\n")]
