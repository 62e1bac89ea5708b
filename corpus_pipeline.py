"""A corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
When a stage begins, tables that an earlier stage stored and that its docs don't read are removed, and so are its shuffles.

Of all stages: documents with null or empty texts stay until the stage that judges them finds otherwise (toxicity and quality
score them like others, near copies keeps one of them, repeats has nothing to cut, packing gives them no bin); texts are read
whole, however long; repeated rows are rows like others, of which near copies keeps one; an empty table gives an empty one;
all columns of documents, and others of any name, are returned as they came but for text and n_chars where repeats cut them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm import common, quality, queries, similar, substring, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []  # folders that earlier stages stored


def _tidy(stage: Stage) -> Stage:
    """The stage, begun by removing what earlier ones left and its docs don't read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LEFT:
            reads = docs.inputFiles()
            gone = [p for p in _LEFT if not any(p.rsplit("/", 1)[1] in f for f in reads)]
            common.forget(spark, gone)
            _LEFT[:] = [p for p in _LEFT if p not in gone]
        common.release(spark)
        with common.owned() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return toxicity.keep_clean(docs, common.read_table(spark, sf_dir, "labels"))


@_tidy
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of poor quality go."""
    return quality.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    Near copies are texts whose sets of five-word shingles have a similarity of 0.8 or more, and what those links chain together:
    SimHash fingerprints and pivot tables link the closest, an exact search by rare shingles the others; all are verified.
    """
    return similar.dedup_similar(docs, threshold=0.8, shingle=5)


@_tidy
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go; documents with nothing left go as well."""
    added = ("n_words", "n_removed", "kept_sha256", "kept_text")
    with common.set_aside(docs, added) as (plain, own):
        cut = substring.substring_dedup(plain).where("n_removed < n_words or n_words = 0")
        changed = F.col("n_removed") > 0
        cut = cut.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            cut = cut.withColumn("n_chars", F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long"))
        return own(cut.drop(*added))


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, in tokens, with their bins."""
    return queries.pack_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

# Learned classifiers and XXH64 fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read_table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{name}")
            common.discard(*before)
            before = [docs]
    return docs
