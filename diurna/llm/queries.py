"""The ten operators' queries over whole tables, and the pipeline; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, embeddings, packing, pieces, quality, simhash, substring, tokens, topk, toxicity

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "token-ids")
    manifest = tokens.write(common.read_table(spark, sf_dir, "documents"), folder, tokenizer_path(BYTE_BPE), end_id=0)
    return tokens.read(spark, manifest, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(common.read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(common.read_table(spark, sf_dir, "documents"), radius=4, shingle=4).select("doc_id", "fingerprint", "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(common.read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE), ids=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(common.read_table(spark, sf_dir, "documents"))


def pack_tokens(docs: DataFrame) -> DataFrame:
    """docs packed by their numbers of tokens, each with one for its end."""
    return packing.pack(tokens.lengths(docs, tokenizer_path(BYTE_BPE)), F.col("n_tokens"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(common.read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality, op2_token_ids, op3_toxicity, op4_top_k, op5_embedding_dedup, op6_simhash, op7_sentencepiece, op8_packing, op9_substring_dedup, op10_chat_format, pipeline)
    return {f.__name__: f for f in named}


_FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP4_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
           from embeddings where vec_id is not null and {_FINITE}),
     e as (select vec_id, len(q) as dim, unnest(range(1, len(q) + 1)) as i, unnest(q) as x from v),
     s as (select a.vec_id as query_id, b.vec_id as vec_id, cast(sum(a.x * b.x) as bigint) as score
           from e a join e b on a.i = b.i and a.dim = b.dim and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1, 2)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""

OP5_SQL = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
           where vec_id is not null and label is not null and {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
           where list_cosine_similarity(a.e, b.e) >= 0.98),
     r as (select vec_id, vec_id as root from embeddings union select r.vec_id, l.b from r join l on l.a = r.root),
     c as (select vec_id, min(root) as component_id from r group by 1),
     n as (select a as vec_id, count(*) as n from l group by 1)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)
"""

OP9_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
     s as (select doc_id, i, array_to_string(ws[i : i + 49], ' ') as words
           from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
     f as (select words, min(doc_id) as low from s group by 1),
     h as (select distinct doc_id, unnest(range(i, i + 50)) as j from s join f using (words) where low < doc_id),
     p as (select doc_id, unnest(range(1, len(ws) + 1)) as j, unnest(ws) as word from w where len(ws) > 0),
     k as (select p.doc_id, string_agg(p.word, ' ' order by p.j) as kept, count(*) as n
           from p left join h on h.doc_id = p.doc_id and h.j = p.j where h.j is null group by 1)
select w.doc_id, len(w.ws) as n_words, len(w.ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op9_substring_dedup": OP9_SQL}
