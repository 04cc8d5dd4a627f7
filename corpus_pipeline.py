"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before kept and returns the same columns; the last returns the pieces
of the packed sequences. A stage decides by its operator of ``slotwise.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.llm import bpe, exact_dedup, jaccard_join, packing, secret_scan, toxicity
from slotwise.llm.common import DOCUMENT_COLUMNS, mapped, table, whole_text
from slotwise.operators.durable import cut_lineage

#: Documents with this score or more are toxic.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity reaches TOXIC. The model learns from the labels of those in ``docs``."""
    model = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("scored", whole_text())

    def keep(stream):
        for *row, text in stream:
            if model.value.score(text) < TOXIC:
                yield row

    return mapped(rows, "doc_id long, text string, lang string, source string, n_chars long", keep)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal normalised texts, the one that exact dedup chose."""
    chosen = exact_dedup.exact_groups(docs).select("text_sha256", "keep_id", "group_size")
    keyed = docs.select(*DOCUMENT_COLUMNS).withColumn("own_sha256", F.sha2(exact_dedup.normalised("text"), 256))
    joined = keyed.join(chosen, F.col("own_sha256") == F.col("text_sha256"))
    return _one_each(joined.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))), "own_sha256")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of linked texts, the one with the smallest id."""
    judged = cut_lineage(jaccard_join.jaccard_join(docs).filter("kept").select("id", "group_key", "text_key"))
    keyed = docs.select(*DOCUMENT_COLUMNS).withColumn("own_key", jaccard_join.text_key("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key"))
    return _one_each(keyed.join(judged.distinct(), same), "group_key")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets that look live by a mark; documents stay, and so do examples that many sources copy."""
    scanned = secret_scan.scan_secrets(docs)
    live = scanned.filter(F.exists("spans", lambda s: s["live"])).select(
        F.col("id").alias("scan_id"), F.col("text_key").alias("scan_key"), F.filter("spans", lambda s: s["live"]).alias("spans")
    ).dropDuplicates(["scan_id", "scan_key"])
    keyed = docs.select(*DOCUMENT_COLUMNS).withColumn("own_key", F.sha2(whole_text(), 256))
    same = F.col("doc_id").eqNullSafe(F.col("scan_id")) & (F.col("own_key") == F.col("scan_key"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("spans")))
    return (
        keyed.join(live, same, "left").withColumn("text", text)
        .withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
        .select(*DOCUMENT_COLUMNS)
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    packed = packing.pack_documents(docs, bpe.tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "certified")


def _one_each(rows: DataFrame, group: str) -> DataFrame:
    """One row of each group, among rows that repeat their id and text."""
    first = F.row_number().over(Window.partitionBy(group).orderBy("text", "lang", "source", "n_chars"))
    return rows.withColumn("turn", first).filter(F.col("turn") == 1).select(*DOCUMENT_COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A model is trained and texts are tokenised on the way, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage is written and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
