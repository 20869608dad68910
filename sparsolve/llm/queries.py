"""The training-data queries that the driver runs, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, license, lines, packing, passages, pii, sharding, topk
from .common import read_table, shared_dir


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read_table(spark, sf_dir, "documents")).withColumn("blocks", F.size("blocks").cast("long")).withColumnRenamed("blocks", "n_blocks")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.topk(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended, compacted and read from the committed version: where each one is."""
    import uuid

    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append(read_table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.lit(store.version()).alias("version"), F.col("_shard").alias("shard"), F.col("_row").alias("row"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_skip_chain_pii": op4_skip_chain_pii,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontamination": op6_decontamination,
    "op7_exact_topk": op7_exact_topk,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, pattern: str, k: int) -> str:
    """(key, s): the distinct k-word shingles, of fewer words the whole sequence."""
    words = f"select {key}, regexp_extract_all({_LOWER.format('text')}, '{pattern}') w from {table} where text is not null"
    cut = f"case when len(w) >= {k} then list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
    return f"select distinct {key}, unnest({cut}) s from ({words})"


ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": f"""
        with recursive s as materialized ({_shingles("documents", "doc_id", "[^\\x20\\x09-\\x0D]+", 4)}),
        n as materialized (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
        e as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
        r(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from r join e on e.x = r.y)
        select r.x doc_id, cast(coalesce(any_value(n.n), 0) as bigint) n_shingles, min(r.y) component_id from r left join n on n.doc_id = r.x group by r.x""",
    "op6_decontamination": f"""
        with d as materialized ({_shingles("documents", "doc_id", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", 5)}),
        q as materialized ({_shingles("benchmark", "item_id", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", 5)}),
        n as (select item_id, count(*) n from q group by item_id),
        c as (select doc_id, item_id, count(*) c from d join q using (s) group by all)
        select doc_id, item_id, c / n containment from c join n using (item_id) where 10 * c >= 8 * n""",
    "op7_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id query_id, c.vec_id vec_id, cast(list_dot_product(q.e, c.e) as bigint) score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), r as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from s
        )
        select * from r where rank <= 5""",
}
