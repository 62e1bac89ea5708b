"""Toxicity by weak supervision: a generative label model over many voters, then a linear classifier on its posteriors.

Voters look at a whole text and vote toxic, clean or nothing. Each word of a fixed lexicon is a voter; so is each word and stem
induced from the labelled sample (those whose presence among clean rows is too rare for chance) and each pattern of writing;
one voter votes clean where no word spoke. The annotators' labels aren't votes: they only name candidate words, and which of
the two hidden classes is the toxic one.

The label model has, for each voter, the rates of its votes given the hidden class, estimated by expectation-maximisation over
the votes alone; it also estimates which voters correlate given the class and discounts each vote by the correlated company
it has. Its posteriors then train a logistic regression over the voters' weighted sum, their kinds and hashed words, which scores
every document.

The fit uses a bounded sample of labelled rows (``TRAIN_ROWS``), scoring is a map over all whole texts, however long. Null and
empty texts have no words and get the score of a text without any. Without labels the lexicon alone decides. A score of 0.5
(a tie) predicts 1. Repeated rows get equal scores; of rows that repeat an id, or a text, one is learned from. A table without
rows gives none. Columns of any other name play no part and, where documents are returned, stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import held_out, labelled_sample

TRAIN_ROWS = 6000
BITS = 16
FOLD, OUT_FOLD = 5, 0
STEMS = (4, 5, 6)
# Fixed word list: common insults of four languages.
LEXICON = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb imbecile "
    "idiota imbécil estúpido basura asqueroso idiote imbécile stupide ordure salaud crétin dumm dummkopf abschaum trottel idioten".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE: dict[str, tuple[int, ...]] = {}


def signals(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of distinct words and stems, pattern counts): a hash's lowest two bits tell word (0) from stem length."""
    text = (text or "").lower()
    tokens = _WORD.findall(text)
    distinct = set(tokens)
    if len(_CACHE) > 60_000:
        _CACHE.clear()
    out: set[int] = set()
    for w in distinct:
        own = _CACHE.get(w)
        if own is None:
            raw = [w.encode(), *(w[:n].encode() for n in STEMS if len(w) >= n)]
            own = _CACHE[w] = tuple((zlib.crc32(r) & ~3) | i for i, r in enumerate(raw))
        out.update(own)
    n = max(1, len(tokens))
    hits = len(distinct & LEXICON)
    patterns = [hits, text.count("!") / n > 0.2, text.count("you") / n > 0.1, text.count("?!") > 0, len(tokens)]
    return np.array(sorted(out), np.int64), np.array(patterns, np.float64)


def induce(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes that occur in toxic rows and in (almost) no clean ones, beyond chance.

    Near copies of one text are one witness, not many.
    """
    if not len(rows) or not 0 < y.sum() < len(y):
        return np.zeros(0, np.int64)
    toxic = [r for r, t in zip(rows, y, strict=True) if t]
    bad, n_bad = np.unique(np.concatenate(toxic), return_counts=True)
    good, n_good = np.unique(np.concatenate([r for r, t in zip(rows, y, strict=True) if not t]), return_counts=True)
    at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
    clean = np.where(good[at] == bad, n_good[at], 0) if len(good) else np.zeros_like(n_bad)
    rate = y.mean()
    total = n_bad + clean
    # how many hashes are as frequent, and the chance of so many toxic rows among so many
    tests = np.log(np.maximum(20, np.bincount(np.minimum(total, 1000), minlength=1001)[np.minimum(total, 1000)]))
    by_chance = clean * (np.log(1 - rate) + np.log(np.maximum(total, 2))) + tests
    chosen = np.flatnonzero((n_bad >= 4) & (n_bad >= 0.95 * total) & (n_bad * np.log(rate) + by_chance < np.log(1e-2)))
    where: dict[int, list[int]] = {h: [] for h in bad[chosen].tolist()}
    for i, r in enumerate(toxic):
        for h in r[np.isin(r, bad[chosen], assume_unique=True)].tolist():
            where[h].append(i)
    out = []
    for k in chosen.tolist():
        witnesses: list[int] = []
        for i in where[int(bad[k])]:
            if all(alike(toxic[i], toxic[j]) < 0.3 for j in witnesses):
                witnesses.append(i)
            if len(witnesses) >= 4 and len(witnesses) * np.log(rate) + by_chance[k] < np.log(1e-2):
                out.append(int(bad[k]))
                break
    return np.array(out, np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes, as a share of the smaller set's."""
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


LEXICON_TERMS = np.unique([zlib.crc32(w.encode()) & ~3 for w in LEXICON])
PATTERNS = (1, 2, 3)  # of a text's signals


def hits(rows: list[np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in terms) of each term in each text."""
    of, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(terms):
        for i, r in enumerate(rows):
            at = np.minimum(np.searchsorted(terms, r), len(terms) - 1)
            at = at[terms[at] == r]
            of.append(np.full(len(at), i))
            which.append(at)
    return np.concatenate(of), np.concatenate(which)


def votes(rows: list[np.ndarray], patterns: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """One row of votes (1 toxic, -1 clean, 0 none) for each text: terms, patterns, and the voter for silence."""
    v = np.zeros((len(rows), len(terms) + len(PATTERNS) + 1), np.float32)
    v[hits(rows, terms)] = 1
    v[:, len(terms) : -1] = patterns[:, PATTERNS] > 0
    v[:, -1] = -1.0 * ~v[:, : len(terms)].any(axis=1)
    return v


class Voters:
    """What the label model learned of each voter: accuracy, weight of a vote, and the share of it that correlation leaves."""

    def __init__(self, accuracy: np.ndarray, odds: np.ndarray, strength: np.ndarray):
        self.accuracy, self.odds, self.strength = accuracy, odds, strength


def companions(v: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
    """Correlation of each two voters' votes given the class, where it is at least ``least``; 0 elsewhere.

    Voters of one kind of vote: from what the majority's classes p don't explain. Voters of both kinds: by agreement. Of three that
    err independently, two agree as often as the product of their (centred) accuracies says, so each accuracy follows from
    three agreements (the median over all threes), and what two agree beyond their product is correlation.
    """
    n, m = v.shape
    mean = [(w @ v) / (w.sum() + 1e-9) for w in (1 - p, p)]
    centred = v - np.outer(1 - p, mean[0]) - np.outer(p, mean[1])
    centred /= np.sqrt((centred**2).mean(axis=0)) + 1e-6
    out = (centred.T @ centred / n).astype(np.float64)
    two = np.flatnonzero((v > 0).any(axis=0) & (v < 0).any(axis=0))
    if len(two) >= 3:
        w = v[:, two].astype(np.float64)
        agree = (w.T @ w) / np.maximum(1, (w != 0).astype(float).T @ (w != 0))
        k = len(two)
        square = np.zeros(k)
        for i in range(k):
            others = [j for j in range(k) if j != i]
            of = [agree[i, j] * agree[i, l] / agree[j, l] for j in others for l in others if j < l and abs(agree[j, l]) > 1e-3]
            square[i] = np.clip(np.median(of) if of else 0.0, 0.0, 0.999)
        by = np.sqrt(np.outer(square, square)) * np.sign(agree)
        out[np.ix_(two, two)] = (agree - by) / np.maximum(1e-3, 1 - np.abs(by))
    np.fill_diagonal(out, 0)
    return np.where(out > least, np.minimum(out, 1), 0)


def label_model(v: np.ndarray, rounds: int = 20, least: float = 0.1) -> tuple[np.ndarray, Voters]:
    """(posterior that a row is toxic, voters), by expectation-maximisation over the votes v. Voters that say nothing add nothing.

    ``least``: correlations below it are taken for noise.
    """
    n, m = v.shape
    up, down = (v > 0).astype(np.float32), (v < 0).astype(np.float32)
    spoke = up + down
    balance = v.sum(axis=1)
    p = np.where(balance > 0, 0.98, np.where(balance < 0, 0.02, 0.5))
    company = companions(v, p, least)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        rate = {}
        for c, weight in ((0, 1 - p), (1, p)):
            total = weight.sum() + 1.0
            rate[c, 1], rate[c, -1] = ((weight @ x + 0.5 * total / n) / total for x in (up, down))
        odds_up, odds_down = np.log(rate[1, 1] / rate[0, 1]), np.log(rate[1, -1] / rate[0, -1])
        share = spoke / (1 + spoke @ company)  # a vote counts less for each correlated voter that spoke as well
        margin = ((up * odds_up + down * odds_down) * share).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + margin, -30, 30)))
    n_votes = np.maximum(1, spoke.sum(axis=0))
    odds = np.where(up.sum(axis=0) >= down.sum(axis=0), odds_up, odds_down)
    return p, Voters((p @ up + (1 - p) @ down) / n_votes, odds, share.sum(axis=0) / n_votes)


class Linear:
    """Logistic regression over voters' signals and hashed words, scaled to unit length."""

    def __init__(self, dense: int):
        self.b, self.d, self.w = 0.0, np.zeros(dense), np.zeros(1 << BITS)

    def margin(self, dense: np.ndarray, at: np.ndarray) -> float:
        return float(self.b + self.d @ dense + self.w[at].sum() / np.sqrt(max(1, len(at))))

    def fit(self, dense: np.ndarray, rows: list[np.ndarray], p: np.ndarray, epochs: int = 5, step: float = 0.3) -> None:
        gb, gd, gw = 1e-2, np.full(len(self.d), 1e-2), np.full(len(self.w), 1.0)
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 32):
                part = order[k : k + 32]
                size = np.array([len(rows[i]) for i in part])
                scale = 1 / np.sqrt(np.maximum(1, size))
                at = np.concatenate([rows[i] for i in part])
                of = np.repeat(np.arange(len(part)), size)
                margin = self.b + dense[part] @ self.d + np.bincount(of, self.w[at], len(part)) * scale
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - p[part]) / len(part)
                db, dd = error.sum(), error @ dense[part]
                places, index = np.unique(at, return_inverse=True)
                dw = np.bincount(index, (error * scale)[of], len(places)) + 1e-5 * self.w[places]
                gb, gd = gb + db * db, gd + dd * dd
                gw[places] += dw * dw
                self.b -= step * db / np.sqrt(gb)
                self.d -= step * dd / np.sqrt(gd)
                self.w[places] -= step * dw / np.sqrt(gw[places])


DENSE = 4 + len(PATTERNS)


class Model:
    """Terms with the weights of their votes, and the classifier."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, linear: Linear, voters: Voters | None = None):
        self.terms, self.weights, self.linear, self.voters = terms, weights, linear, voters

    def dense(self, rows: list[np.ndarray], patterns: np.ndarray) -> np.ndarray:
        """The classifier's inputs beside words: the terms' weighted sum, whether any and whether several spoke, lexicon, patterns."""
        of, which = hits(rows, self.terms)
        total = np.bincount(of, self.weights[which], len(rows)) if len(of) else np.zeros(len(rows))
        n = np.bincount(of, minlength=len(rows))
        return np.column_stack([np.clip(total / 5, -2, 2), n > 0, n > 1, patterns[:, 0] > 0, patterns[:, PATTERNS] > 0]).astype(float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        made = [signals(t) for t in texts]
        rows, patterns = [m[0] for m in made], np.stack([m[1] for m in made])
        margins = np.array([self.linear.margin(d, places(r)) for d, r in zip(self.dense(rows, patterns), rows, strict=True)])
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def places(row: np.ndarray) -> np.ndarray:
    return np.unique((row >> 2) & ((1 << BITS) - 1))


def fit(rows: list[np.ndarray], patterns: np.ndarray, y: np.ndarray) -> Model:
    terms = np.union1d(induce(rows, y), LEXICON_TERMS)
    v = votes(rows, patterns, terms)
    terms, v = terms[(spoke := v[:, : len(terms)].any(axis=0))], v[:, np.concatenate([spoke, np.ones(v.shape[1] - len(terms), bool)])]
    p, voters = label_model(v)
    if y.std() and ((p - p.mean()) * (y - y.mean())).sum() < 0:  # the labels say which class is which
        p, voters.odds = 1 - p, -voters.odds
    linear = Linear(DENSE)
    model = Model(terms, (voters.odds * voters.strength)[: len(terms)], linear, voters)
    linear.fit(model.dense(rows, patterns), [places(r) for r in rows], p)
    return model


def lexicon_only() -> Model:
    linear = Linear(DENSE)
    linear.b, linear.d[3] = -1.0, 3.0
    return Model(LEXICON_TERMS, np.zeros(len(LEXICON_TERMS)), linear)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model fitted on at most ``rows`` labelled documents."""
    common.small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", FOLD, OUT_FOLD, rows).select("y", F.xxhash64("text").alias("same"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [signals(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.uint32).view(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float64()))], names=["y", "same", "at", "x"])

    def learn(got: pa.Table) -> Model:
        y, same = (got.column(c).to_numpy() for c in ("y", "same"))
        order = np.lexsort((y, same))  # one row of each text, whatever order they came in
        order = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]
        (ats, at), (xs, _) = common.lists(got.column("at")), common.lists(got.column("x"))
        return fit([ats[at[i] : at[i + 1]].view(np.uint32).astype(np.int64) for i in order], xs.reshape(len(y), -1)[order], y[order].astype(float))

    return common.fitted(common.map_batches(sample, run, "y int, same long, at array<int>, x array<double>"), learn) or lexicon_only()


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with ``score`` and ``predicted``; columns of these names are replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    sent = spark.sparkContext.broadcast(model)
    n = len(keep)
    rows = docs.select(*[F.col(c).alias(f"d_{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    schema = docs.select(*keep).schema
    for i, f in enumerate(schema.fields):
        f.name = f"d_{i}"
    schema = schema.add("score", "double").add("predicted", "integer")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = sent.value.scores(batch.column(n).to_pylist())
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    out = common.map_batches(rows, run, schema)
    return out.select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each document."""
    scored = score(docs, train(docs, labels, rows), ["doc_id"])
    return scored.select("doc_id", held_out(FOLD, OUT_FOLD).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents not predicted to be toxic; docs' own columns of any name stay."""
    model = train(docs, labels, rows)
    with common.set_aside(docs, ("score", "predicted")) as (plain, own):
        return own(score(plain, model).where("predicted = 0"))
