"""The corpus pipeline: language ID, line dedup, near-duplicate documents, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's documents.
All but the last return the columns of documents; each works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsolve.llm import decontaminate, jaccard, langid, lines, packing
from sparsolve.llm.common import Scratch, read_table, small_batches, spare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if its likeliest language is less likely than so many times an even share.
LEAST_SHARE = 1.2


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of doc_id (which may be null or repeated) and text, under a name that no column has."""
    key = spare(docs.columns, "key")
    return docs.withColumn(key, F.xxhash64("doc_id", F.lit("|"), "text")), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go: null and letterless texts, and those whose calibrated score is below LEAST_SHARE over the number of languages.

    A missing lang becomes the predicted one.  If there is nothing to learn from, only null and letterless texts go.  Rows with a null doc_id and
    repeated rows are looked at like others; very long texts whole; an empty table stays empty."""
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs, model, COLUMNS)
    letters = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    sure = F.col("score") >= LEAST_SHARE / len(model.langs) if len(model.langs) > 1 else F.lit(True)
    lang = F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred"))).alias("lang")
    return told.where(letters & sure).select(*(lang if c == "lang" else c for c in COLUMNS))


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier place (by doc_id, nulls last, then line) go; so do documents of which nothing is left.

    Null and empty texts have no lines and stay; rows of equal doc_id and text are one document, so all of them stay here; an empty table stays empty."""
    return lines.without_duplicates(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by five-word shingles at 0.8, one stays: that with the smallest doc_id (nulls last; of several texts under one doc_id any one, but always the same).

    Rows are told apart by doc_id and text, so null and repeated doc_ids are no matter; of rows equal in both one stays.  Texts without words are near
    to nothing; very long texts are compared whole; an empty table stays empty."""
    keyed, key = _keyed(docs)
    scratch = Scratch(spark, "near")
    keys = scratch.save(keyed.groupBy(F.col(key).alias("k")).agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).alias("doc"), F.count("*").alias("n")), "keys")
    classes = jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100)
    rooted = keys.join(classes.select(F.col("doc_id").alias("k"), F.col("component_id").alias("root")).distinct(), "k")
    rooted = scratch.save(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc", "k")).alias("f"))
    gone = scratch.save(rooted.join(first, "root").where("k <> f.k").select(F.col("k").alias(key)), "gone")
    again = keys.where("n > 1").select(F.col("k").alias(key))
    left = keyed.join(gone, key, "left_anti")
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, told apart by doc_id and text: one with a null doc_id too, and not another text under the same doc_id.

    Null, empty and short texts hold no item; very long ones are looked at whole; repeated rows go or stay together; an empty table stays empty."""
    keyed, key = _keyed(docs)
    found = decontaminate.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row per piece; see `packing.pack` for nulls, empty and very long texts."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_duplicate_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Learnt language models and token ids are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    out = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = scratch.save(out, f"stage{k}")
    return out
