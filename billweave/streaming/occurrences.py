"""Occurrences of unresolved wording as a stream: the keyed counts of the batch form, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from billweave.functions.text import with_normalized

KEYS = ("tenant_id", "partner_id", "normalized")


def keyed(lines: DataFrame) -> DataFrame:
    """Stream or table of lines with the key of their wording."""
    return with_normalized(lines.filter(F.col("description").isNotNull()), "description")


def running_occurrences(lines: DataFrame) -> DataFrame:
    """Count, first and last sighting per wording; grows with the distinct wordings, not with the rows."""
    return keyed(lines).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at")
    )


def start(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed wordings to ``path``/batch=N; writing a batch again replaces it."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = running_occurrences(lines).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(batches: DataFrame) -> DataFrame:
    """The newest state of each wording from the written batches."""
    newest = batches.groupBy(*KEYS).agg(F.max_by(F.struct("occurrence_count", "first_seen_at", "last_seen_at"), "batch").alias("s"))
    return newest.select(*KEYS, "s.*")
