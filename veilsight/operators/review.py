"""Review states of findings over runs: merged with a scan, and set by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("new", "confirmed", "resolved", "false_positive")
SCHEMA = "key string, status string, memo string, updated_at string, last_seen_at string, reappeared boolean"


def merge_scan(entries: DataFrame, keys: DataFrame, scan: str) -> DataFrame:
    """Entries after a scan that found ``keys``: seen ones get its time, resolved ones seen again reappear.

    Times are compared as text. Entries that the scan hasn't seen stay as they are, and findings without
    an entry make none.
    """
    seen = keys.select("key").distinct().withColumn("__seen", F.lit(True))
    e = entries.join(seen, "key", "left")
    hit = F.coalesce("__seen", F.lit(False))
    again = (F.col("status") == "resolved") & ~F.col("last_seen_at").eqNullSafe(F.lit(scan)) & (F.col("updated_at").isNull() | (F.col("updated_at") <= scan))
    return e.select(
        "key", "status", "memo", "updated_at", F.when(hit, F.lit(scan)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (F.col("reappeared") | (hit & F.coalesce(again, F.lit(False)))).alias("reappeared"),
    )


def set_status(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after changes ``key, status, memo, updated_at``; the latest of a key counts, unknown states are an error."""
    ok = F.col("status").isin(*STATUSES)
    checked = changes.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null"))))))
    last = checked.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("updated_at").desc()))).where("n = 1")
    last = last.select("key", F.col("status").alias("s"), F.coalesce("memo", F.lit("")).alias("m"), F.col("updated_at").alias("u"), F.lit(True).alias("changed"))
    both = entries.join(last, "key", "full")
    new = lambda a, b: F.when(F.col("changed"), F.col(a)).otherwise(F.col(b)).alias(b)
    return both.select("key", new("s", "status"), new("m", "memo"), new("u", "updated_at"), "last_seen_at", F.when(F.col("changed"), False).otherwise(F.col("reappeared")).alias("reappeared"))
