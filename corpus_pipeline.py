"""The corpus pipeline: filters, deduplicates, decontaminates, masks and packs documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm import decontaminate, near_dedup, packing, private_data, quality
from eventlens.llm.storage import table, written

#: What every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of ``op4`` accepts (score 0.5 or more)."""
    net = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, net).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Of several rows of one kept id that one stays which is least by text and the other columns;
    rows without an id stay.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=85)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return named.select(*docs.columns).union(docs.where("doc_id is null"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``: fewer than one word in 20 is a hit.

    Rows are matched by a hash of id and text, so each row is judged by its own text.
    """
    row = F.xxhash64("doc_id", "text")
    texts = docs.select(row.alias("row"), "text")
    found = decontaminate.contamination(texts, table(spark, sf_dir, "benchmark"), id_col="row")
    bad = decontaminate.judged(found).where("contaminated").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row).join(bad, "__row", "left_anti").select(*docs.columns)


def private_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text replaced by its kind; ``n_chars`` is counted anew where it was."""
    out = private_data.masked(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("PII", private_data_masked),
    ("packing", packed),
]
#: Trained weights, signatures and merges have no SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
