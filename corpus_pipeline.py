"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept;
stages are written as Parquet in the shared folder in between. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import forest, packing, quality, substrings
from tensorloom.llm.texts import shared_folder

SEQUENCE_TOKENS = 2048
END_ID = 0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps; NULL and empty texts are rejected."""
    judged = quality.ledger(docs, name="_ledger")
    kept = judged.filter(~quality.rejects(F.col("_ledger.failed"), quality.CURRENT))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class; of rows that share it, the one whose text sorts first.

    Rows with a NULL id are in no class and stay.
    """
    classes = forest.near_duplicates(docs).filter(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(classes, "doc_id", "left_anti")
    # The join has dealt the rows by id, so this adds no shuffle.
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    whole = F.struct(F.coalesce("text", F.lit("")), *[F.col(f"`{c}`") for c in docs.columns])
    once = kept.withColumn("_alone", alone).groupBy("doc_id", "_alone").agg(F.min(whole).alias("_row"))
    return once.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand in an earlier document; n_chars follows.

    A character of which some bytes would go stays: a span is narrowed to whole
    characters. Texts of which nothing is left go.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substrings.remove_repeats(docs, whole_characters=True, carry=rest).withColumn("_text", F.col("kept").cast("string"))
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)}
    columns = [own.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns]
    return cut.filter(F.length("_text") > 0).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.cut_documents(docs, path, end_id=END_ID, capacity=SEQUENCE_TOKENS)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(slim, "length", SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("sum-of-squares packing", pack),
]

# Signatures, suffix orders and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
