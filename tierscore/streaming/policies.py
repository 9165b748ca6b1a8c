"""Two-tier decisions on a stream, under threshold tables that are replaced while it runs.

A :class:`PolicyStore` keeps versions of the tables in a shared folder. Every trigger of the stream joins
its rows to one version: the newest that was complete when the trigger began. The choice is noted
before the trigger scores, so a trigger that is run again after a failure decides as it did before, and
its output, named after the trigger, replaces what the failed run left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierscore.session import scratch_path

NOTED = "trigger bigint, version bigint"


@dataclass(frozen=True)
class PolicyStore:
    """Versions of ``global_tau`` and ``segment_tau`` below ``path``; a version counts once it is marked."""

    spark: SparkSession
    path: str

    def publish(self, version: int, global_tau: DataFrame, segment_tau: DataFrame) -> None:
        """Write the tables of a version, then its mark; an unfinished one is never used."""
        global_tau.write.mode("overwrite").parquet(f"{self.path}/version={version}/global_tau")
        segment_tau.write.mode("overwrite").parquet(f"{self.path}/version={version}/segment_tau")
        mark = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/complete")

    def newest(self) -> int:
        found = self.spark.read.schema("version bigint").parquet(f"{self.path}/complete").agg(F.max("version")).first()[0]
        if found is None:
            raise ValueError(f"no complete policy version in {self.path}")
        return found

    def tables(self, version: int) -> tuple[DataFrame, DataFrame]:
        at = f"{self.path}/version={version}"
        return tuple(self.spark.read.parquet(f"{at}/{t}") for t in ("global_tau", "segment_tau"))


@dataclass(frozen=True)
class Notes:
    """Which version each trigger of a stream used, in a folder of small files."""

    spark: SparkSession
    path: str

    def start(self) -> None:
        self.spark.createDataFrame([], NOTED).write.mode("append").parquet(self.path)

    def version_for(self, trigger: int, store: PolicyStore) -> int:
        """The noted version of a trigger that is run again, else the newest one, which is noted."""
        noted = self.spark.read.schema(NOTED).parquet(self.path).where(F.col("trigger") == trigger).first()
        if noted is not None:
            return noted["version"]
        version = store.newest()
        row = self.spark.range(1).select(F.lit(trigger).cast("bigint").alias("trigger"), F.lit(version).cast("bigint").alias("version"))
        row.coalesce(1).write.mode("append").parquet(self.path)
        return version


def stream_score(
    sdf: DataFrame,
    decide: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    store: PolicyStore,
    out: str,
    state: str,
) -> StreamingQuery:
    """Start deciding all available rows of a stream.

    ``decide(rows, global_tau, segment_tau)`` is the batch cascade. ``out`` receives one folder per
    trigger, with the ``policy_version`` that decided; ``state`` holds the checkpoint and the notes.
    """
    notes = Notes(sdf.sparkSession, f"{state}/policy-notes")
    notes.start()

    def score(rows: DataFrame, trigger: int) -> None:
        version = notes.version_for(trigger, store)
        decided = decide(rows, *store.tables(version))
        decided.withColumn("policy_version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

    writer = sdf.writeStream.option("checkpointLocation", f"{state}/stream").trigger(availableNow=True)
    return writer.foreachBatch(score).start()


def score_available(sdf: DataFrame, decide: Callable[..., DataFrame], store: PolicyStore, name: str = "decisions") -> DataFrame:
    """The decisions of all rows that are available now."""
    spark = sdf.sparkSession
    out = scratch_path(spark, name)
    stream_score(sdf, decide, store, out, scratch_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.parquet(out).drop("trigger")
