"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.llm import collocations, conversations, decontamination, html_layout, jaccard_join, language_id, licenses, nearest, oracle, pitman_yor, toxicity, urls
from airmetrics.llm.common import id_remainder, read_table
from airmetrics.llm.packing import pack
from airmetrics.llm.sharding import shard_documents


def op1_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter is held out of the learning."""
    documents = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    filters = language_id.fit(documents.where(id_remainder(F.col("doc_id"), 4) != 2))
    found = language_id.with_language(documents.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_layout.extract(read_table(spark, sf_dir, "pages").select("page_id", "html")).drop("html")


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    placed = shard_documents(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in every document."""
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document states."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.withColumn("licences", F.array_join("licences", " AND "))


#: The rules of the contract.
URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of every page; pages of low-quality documents are the bad labels."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("label_id"), (1 - F.col("quality")).cast("long").alias("bad")
    )
    return urls.judge(read_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op7_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False)


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, copies and links of every document."""
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; a fifth of the labels is held out of the learning."""
    documents = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    learned = toxicity.fit(documents, labels.where(id_remainder(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = toxicity.with_toxicity(documents.select("doc_id", "text"), learned)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    found = nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def op11_count_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document; a seventh is held out of the learning."""
    documents = read_table(spark, sf_dir, "documents")
    model = pitman_yor.fit(documents.where(id_remainder(F.col("doc_id"), 7) != 2))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return pitman_yor.with_scores(documents, model, held_out)


def op13_dijkstra_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a known rule, with its cheapest repair."""
    return conversations.repair(conversations.damaged(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_language_filters": op1_language_filters,
    "op2_layout_text": op2_layout_text,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_simhash_windows": op4_simhash_windows,
    "op5_license_rules": op5_license_rules,
    "op6_path_templates": op6_path_templates,
    "op7_bounded_packing": op7_bounded_packing,
    "op8_minhash_forest": op8_minhash_forest,
    "op9_string_kernel": op9_string_kernel,
    "op10_multi_index": op10_multi_index,
    "op11_count_streams": op11_count_streams,
    "op12_pitman_yor": op12_pitman_yor,
    "op13_dijkstra_repair": op13_dijkstra_repair,
}
ORACLE = {
    "op5_license_rules": oracle.license_sql(),
    "op6_path_templates": oracle.url_sql(URL_RULES),
    "op11_count_streams": oracle.COLLOCATIONS,
}
