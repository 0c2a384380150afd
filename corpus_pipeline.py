"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``docs``. ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again for the next.

1. quality: documents with a score below ``GOOD_FROM`` go. Fitted on the
   labelled documents whose crc32(doc_id) mod 5 is not 0.
2. near_duplicates: of every group of documents linked by five-word shingles
   with a Jaccard of 0.8 or more, one stays: that with the smallest id (none
   last), then the smallest hash of the text. Groups are told apart by their
   texts, so near copies that share an id, or have none, leave one row too.
   Documents without a word are in no group and stay, once per id and text.
3. decontaminate: documents that hold a benchmark passage go.
4. secrets: secrets are masked in the text; ``n_chars`` follows it. No document
   goes.
5. pack: one row per piece of the packed sequences.

Null and empty texts, repeated rows, empty tables and columns of other names
are handled as the operators say; other columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontamination, jaccard_join, packing, quality, secret_scan
from marketlens.llm._shared import free_name, read_table, ship_code, written
from marketlens.llm.queries import GOOD_FROM, shipped, usable_quality_label


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), usable_quality_label())
    score = free_name(docs, "quality_score")
    return quality.score(docs, model, score).where(F.col(score) >= GOOD_FROM).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, kept_id, kept_key = (free_name(docs, name) for name in ("text_key", "kept_id", "kept_key"))
    kept = jaccard_join.representatives(jaccard_join.text_groups(docs)).withColumnsRenamed({"id": kept_id, "key": kept_key})
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & F.col(key).eqNullSafe(F.col(kept_key))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.without_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", shipped(good_documents)),
    ("near_duplicates", shipped(one_of_each_group)),
    ("decontaminate", shipped(without_benchmark)),
    ("secrets", shipped(without_secrets)),
    ("pack", shipped(packed)),
]

# Trained models and best-fit packing have no SQL form; tests/llm compares
# each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
