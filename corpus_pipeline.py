"""Training-corpus pipeline: drops toxic and repeated documents and benchmark leaks, then packs.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and is the next stage's
input. All but the last return the columns of ``docs``. Decisions are narrow tables joined back by
id: rows with a null id carry no decision and stay, as do rows with null texts; repeated rows of one
id share its decision, and the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierscore.llm import decontamination, near_dups, packing, toxicity
from tierscore.llm.common import table
from tierscore.operators.skew import is_small
from tierscore.session import materialise, use_text_batches

SHINGLE, PERCENT = 5, 80
BROADCAST_IDS = 2_000_000  # rejected ids that are sent to every task, some 100 MB; beyond them the texts move once


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose id is not in ``rejected`` (``doc_id``)."""
    ids = materialise(rejected.select("doc_id").distinct(), "rejected")
    small = is_small(ids, BROADCAST_IDS)
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_text_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).where("predicted = 1 and doc_id is not null")
    return _without(docs, materialise(scored.select("doc_id"), "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_text_batches(spark)
    decided = near_dups.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    decided = materialise(decided.where("doc_id is not null"), "decided")
    clean = _without(docs, decided.where("not kept"))
    repeated = materialise(decided.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return clean
    # Only the rows of repeated ids move to the task of their id.
    one = Window.partitionBy("doc_id").orderBy(F.lit(0))
    copies = clean.join(repeated, "doc_id", "left_semi").withColumn("__copy", F.row_number().over(one)).where("__copy = 1")
    return _without(clean, repeated).unionByName(copies.select(*docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_text_batches(spark)
    hits = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, materialise(hits.where("doc_id is not null").select("doc_id"), "leaks"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_text_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
# Learnt scores, chosen paths and best fit are not SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
