"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all rows that the one before it has stored and returns the columns of
``documents``; the last returns pieces of sequences. Null ids and texts pass through the stages
that do not reject them: a text without letters is rejected by language identification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.llm import decontamination, jaccard_join, language_id, packing, toxicity
from airmetrics.llm.common import maybe_among, read_table, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel does not find toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)("text") < 0.5)


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the n-gram filters recognise."""
    return language_id.identified(docs, language_id.fit(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the least id.

    Rows are told apart by a number of their own, so null and repeated ids decide nothing; a null
    id comes last, and of equal ids the first row stays. Null texts are in no group.
    """
    row, id_name = (f"_{name}_{len(docs.columns)}" for name in ("row", "id"))
    # Stored, so that a row has the same number in every pass.
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard_join.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    shared = found.groupBy("class_id").agg(F.count("*").alias("rows")).where("rows > 1").select("class_id")
    members = found.select(F.col("doc_id").alias(row), "class_id").join(shared, "class_id")
    members = members.join(numbered.select(row, F.col("doc_id").alias(id_name)), row)
    stays = F.min_by(row, F.struct(F.col(id_name).isNull(), id_name, row)).alias("stays")
    best = members.groupBy("class_id").agg(stays)
    gone = stored(members.join(best, "class_id").where(F.col(row) != F.col("stays")).select(row), "gone")
    # Most documents cannot be among those that go; only the others are shuffled to find out.
    sure = maybe_among(numbered, gone, row, maybe=False)
    kept = maybe_among(numbered, gone, row).join(gone, row, "left_anti")
    return sure.select(docs.columns).unionByName(kept.select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_known_language),
    ("near duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Learned decisions and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it has stored."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
