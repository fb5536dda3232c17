"""Scans of pages as they arrive: files of a folder or any stream, one scan per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..plans import scan
from ..sources.tables import release, stored, written

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def unseen_pages(batch: DataFrame, seen: str, number: int) -> DataFrame:
    """Pages of a batch whose visit key no earlier batch has had, each once, with the key as ``visit``.

    The keys are a Parquet table by batch, not state of the stream: they cost no executor memory, and a batch
    that is run again looks at those before it only.
    """
    spark = batch.sparkSession
    pages = batch.where(F.col("url").isNotNull()).withColumn("visit", U.visit_key("url"))
    first = pages.groupBy("visit").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p")).select("p.*", "visit")
    if number == 0:
        return first
    before = spark.read.schema("visit string, batch long").option("basePath", seen).parquet(seen).where(F.col("batch") < number)
    return first.join(before.select("visit"), "visit", "left_anti").select("page_id", "url", "html", "visit")


def scan_stream(pages: DataFrame, out: str, checkpoint: str, css: str = "", extras: bool = True, available_now: bool = True) -> StreamingQuery:
    """Appends findings to a Parquet folder by batch; a batch that is run again replaces its own files.

    A finding seen in several batches is written by each; ``findings_so_far`` keeps the first.
    """
    seen = f"{checkpoint.rstrip('/')}/visited"

    def run(batch: DataFrame, number: int) -> None:
        mark = written()
        fresh = stored(unseen_pages(batch, seen, number), "pages")
        scan.scan(fresh.drop("visit"), css, extras).findings.write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.select("visit").write.mode("overwrite").parquet(f"{seen}/batch={number}")
        release(mark)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def findings_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The findings written until now, the first of each key."""
    rows = spark.read.parquet(out)
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in ("key", "batch")]), F.col("batch")).alias("f")
    return rows.groupBy("key").agg(first).select("key", "f.*")


def progress(query: StreamingQuery) -> dict:
    """Counts of the last batch, for live reports."""
    last = query.lastProgress
    return {"batch": last["batchId"], "pages": last["numInputRows"]} if last else {"batch": -1, "pages": 0}
