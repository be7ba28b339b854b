"""A training-corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir); ``run`` writes what it returns as Parquet to the shared
folder and hands it, read again, to the next one. What a stage wrote on its way is deleted when the
stage is done, and its input when the next one has read it. All stages but the last return the columns of
``documents``; the last returns what is trained on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import decontaminate, ngram_join, pieces, quality, suffix_dedup
from rillmark.llm.common import cleared, forget, reachable, row_key, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def only(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose id and key are in ``keys`` (or, left_anti, are not)."""
    keyed = docs.select(*COLUMNS, row_key("doc_id", "text").alias("_key"))
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("key").alias("_own")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own"))
    return keyed.join(keys, on, how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text is rejected; a very long one is judged whole. Repeated rows are judged alike, so all of them stay or all go;
    if they name several languages, all go where one of them rejects the text. A null language is one
    of its own. An empty table stays empty; other columns than those of documents go.
    """
    reachable(spark)
    judged = quality.judge(docs.withColumn("key", row_key("doc_id", "text")).select(*COLUMNS, "key"), keep=("key",))
    return only(docs, judged.where("not kept").select("doc_id", "key"), "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least id stays, ids of null last; among rows
    of one id, that of the least key.

    Repeated rows are linked, so one of them stays. Null, empty and wordless texts are linked with nothing
    and stay, once for each id. Very long texts are compared whole. An empty table stays empty; other columns go.
    """
    reachable(spark)
    linked = ngram_join.link_documents(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    stays = linked.groupBy("group_id").agg(first.alias("first")).select("first.doc_id", "first.key")
    return only(docs, stays).dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go out of the texts; every row stays, with n_chars of what is left.

    A null text stays null, an empty one empty; of very long ones every byte is looked at. Repeated rows are repeats of each other and lose all text of 200 bytes and
    more. An empty table stays empty; other columns go.
    """
    reachable(spark)
    done = suffix_dedup.deduplicate(docs, keep=("lang", "source"))
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts stay; very long ones are searched whole. Repeated rows all stay or all go. Empty tables on either side reject
    nothing; other columns go.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return only(docs, found.where(decontaminate.is_contaminated()).select("doc_id", "key"), "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with the end id), n_tokens, and whether the ids decode to the text, of every row.

    A null or empty text has the end id only; a very long one is encoded whole. An empty table stays empty.
    """
    reachable(spark)
    coded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with cleared() as keep:
            before, docs = docs, keep(written(stage(spark, docs, sf_dir), f"stage-{k}"))
        forget(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
