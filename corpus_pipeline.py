"""A corpus pipeline: quality classifier, near-dedup, decontamination, PII, byte-level BPE.

Each stage reads what the one before wrote.  All but the last return the columns of ``documents``.

Defined results.  Rows with null ids or texts pass through every filter that does not reject them.
Empty tables: empty results.  Repeated ids: each row is judged by its own text, and the dedup stage
keeps one row of a group of copies, the one with the least id (null ids last, then the least text
hash), however ids repeat; rows without words are never copies.  Very long texts: whole.  Extra
columns, whatever their names, are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm import byte_bpe, common, decontaminate, near_dedup, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, common.load(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(COLUMNS), model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the least id, null ids last, however ids repeat."""
    docs = docs.select(COLUMNS)
    # rows are named by id and text hash; only names that stand for several equal rows are thinned by dropping duplicates
    found = near_dedup.groups(docs).where("group IS NOT NULL")
    members = common.materialize(found.groupBy("group", "doc_id", "mark").agg(F.count("*").alias("c")), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    best = members.groupBy("group").agg(first, F.sum("c").alias("n")).where("n > 1")
    best = common.materialize(best.select("group", F.col("first.doc_id").alias("best_id"), F.col("first.mark").alias("best_mark")), "best")
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))
    judged = members.join(best, "group").select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), stays.alias("stays"), "c")
    judged = common.materialize(judged.where("NOT stays OR c > 1"), "judged")
    for done in (members, best):
        common.forget(done)
    rows = docs.withColumn("_mark", F.xxhash64("text"))
    named = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("_mark") == F.col("of_mark"))
    once = rows.join(judged.where("stays"), named, "left_semi").dropDuplicates(["doc_id", "_mark"])
    return rows.join(judged, named, "left_anti").unionByName(once).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contaminated(docs.select(COLUMNS), common.load(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text; n_chars follows."""
    return pii.masked(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded bytes."""
    return byte_bpe.round_trip(docs, with_tokens=True)


STAGES = [
    ("quality_classifier", classify),
    ("near_dedup", dedup),
    ("decontamination", decontaminated),
    ("personal_data", hide_personal_data),
    ("byte_bpe", encode),
]

#: The classifier and the sequence model cannot be put in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = common.load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        if k:
            common.forget(before)  # the stage's output is written, so nothing reads its input any more
    return STAGES[-1][1](spark, docs, sf_dir)
