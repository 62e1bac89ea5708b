"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2)): all pairwise interactions in time linear
in the features present. Words count once each, scaled to unit length; statistics and the metadata column ``n_chars`` (its
logarithm, and whether it is missing) are dense features. The machine is fitted by AdaGrad on a bounded sample of labelled rows
(``TRAIN_ROWS``); scoring is a map over all whole texts with the model (a fixed size) broadcast.

Empty and null texts are scored like others, with no words; very long texts are scored whole. Without labels every score is
0.5. A score of 0.5 (a tie) predicts 1. Repeated rows get equal scores; of rows that repeat an id, or a text, one is learned
from. A table without rows gives none. Columns of any other name play no part and, where documents are returned, stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import STATS, hashed, held_out, labelled_sample, stats

TRAIN_ROWS = 8000
BITS = 16
RANK = 8
EPOCHS = 6
DENSE = len(STATS) + 2
FOLD, OUT_FOLD = 3, 1


def featurize(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): hashed words first, then the dense features."""
    raw = text or b""
    words = raw.split()
    at = hashed({w.lower() for w in set(words)}, BITS)
    dense = np.concatenate([stats(raw, words), [0.0, 1.0] if n_chars is None else [np.log1p(max(0, n_chars)) / 10, 0.0]])
    values = np.concatenate([np.full(len(at), 1 / np.sqrt(max(1, len(at)))), dense])
    return np.concatenate([at, (1 << BITS) + np.arange(DENSE)]), values


class Machine:
    """A factorisation machine with logistic loss."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 1):
        self.b = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.b + self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, step: float = 0.1, decay: float = 1e-5, batch: int = 64) -> None:
        positive = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.b = float(np.log(positive / (1 - positive)))
        gw, gv, gb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        rng = np.random.default_rng(2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                size = np.array([len(rows[i][0]) for i in part])
                at = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])[:, None]
                begin = np.concatenate([[0], np.cumsum(size)[:-1]])
                v = self.v[at]
                vx = v * x
                s = np.add.reduceat(vx, begin, axis=0)
                margin = self.b + np.add.reduceat(self.w[at] * x[:, 0], begin) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), begin))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
                e = np.repeat(error, size)[:, None]
                places, index = np.unique(at, return_inverse=True)
                grad = np.zeros((len(places), self.v.shape[1] + 1))
                each = np.hstack([e * x, e * x * (np.repeat(s, size, axis=0) - vx)])
                order_by = np.argsort(index, kind="stable")
                grad = np.add.reduceat(each[order_by], np.searchsorted(index[order_by], np.arange(len(places))), axis=0)
                dw, dv = grad[:, 0] + decay * self.w[places], grad[:, 1:] + decay * self.v[places]
                gw[places] += dw * dw
                gv[places] += dv * dv
                self.w[places] -= step * dw / np.sqrt(gw[places])
                self.v[places] -= step * dv / np.sqrt(gv[places])
                db = error.sum()
                gb += db * db
                self.b -= step * db / np.sqrt(gb)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine fitted on at most ``rows`` labelled documents; None without labels."""
    common.small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", FOLD, OUT_FOLD, rows)
    sample = sample.select("y", F.xxhash64("text").alias("same"), "text", "n_chars")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [featurize(t, n) for t, n in zip(common.raw_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in made], pa.list_(pa.float32()))], names=["y", "same", "at", "x"])

    def fit(got: pa.Table) -> Machine:
        y, same = (got.column(c).to_numpy() for c in ("y", "same"))
        order = np.lexsort((y, same))  # one row of each text, whatever order they came in
        order = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]
        (ats, at), (xs, _) = common.lists(got.column("at")), common.lists(got.column("x"))
        machine = Machine((1 << BITS) + DENSE)
        machine.fit([(ats[at[i] : at[i + 1]], xs[at[i] : at[i + 1]].astype(np.float64)) for i in order], y[order].astype(float))
        machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
        return machine

    return common.fitted(common.map_batches(sample, run, "y int, same long, at array<int>, x array<float>"), fit)


def score(docs: DataFrame, machine: Machine | None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with ``score`` and ``predicted``; columns of these names are replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    model = spark.sparkContext.broadcast(machine and (machine.b, machine.w, machine.v))
    n = len(keep)
    has = "n_chars" in docs.columns
    rows = docs.select(*[F.col(c).alias(f"d_{i}") for i, c in enumerate(keep)], F.col("text").alias("t"), (F.col("n_chars").cast("long") if has else F.lit(None).cast("long")).alias("m"))
    schema = docs.select(*keep).schema
    for i, f in enumerate(schema.fields):
        f.name = f"d_{i}"
    schema = schema.add("score", "double").add("predicted", "integer")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model.value is None:
            p = np.full(batch.num_rows, 0.5)
        else:
            m = Machine(0)
            m.b, m.w, m.v = model.value
            margins = [m.margin(*featurize(t, c)) for t, c in zip(common.raw_texts(batch.column(n)), batch.column(n + 1).to_pylist(), strict=True)]
            p = 1 / (1 + np.exp(-np.clip(np.array(margins), -30, 30)))
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    out = common.map_batches(rows, run, schema)
    return out.select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each document."""
    scored = score(docs, train(docs, labels, rows), ["doc_id"])
    return scored.select("doc_id", held_out(FOLD, OUT_FOLD).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents predicted to be of good quality, all of them without labels; docs' own columns of any name stay."""
    machine = train(docs, labels, rows)
    with common.set_aside(docs, ("score", "predicted")) as (plain, own):
        return own(score(plain, machine).where("predicted = 1"))
