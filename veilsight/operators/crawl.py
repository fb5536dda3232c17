"""Crawl events: responses, kinds of failure, streaks, pacing, counters, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABORT_STREAK, POLITE_LEAST, POLITE_MOST, POLITE_RECOVERY = 40, 300, 3000, 30
TRANSIENT = (
    r"net::ERR_(?:CONNECTION_RESET|CONNECTION_CLOSED|CONNECTION_ABORTED|EMPTY_RESPONSE|TIMED_OUT|NETWORK_CHANGED|HTTP2_PROTOCOL_ERROR"
    r"|QUIC_PROTOCOL_ERROR|SOCKET_NOT_CONNECTED)\b"
)
EXIT_CODES = {"COMPLETED": 0, "BUDGET": 0, "STOPPED": 0, "BLOCKED": 0, "ERROR": 1, "INVALID_INPUT": 2}


def readable() -> Column:
    """Responses that are pages: no error, HTML or XML."""
    return (F.col("status") < 400) & (F.col("content_type").isNull() | F.col("content_type").rlike("html|xml"))


def failure(message: Column, timed_out: Column) -> Column:
    return (
        F.when(message.isin("HTTP 404", "HTTP 410"), "OTHER")
        .when(message.startswith("HTTP "), "REFUSED")
        .when(F.contains(message, F.lit("Download is starting")), "FILE")
        .when(timed_out | message.rlike(TRANSIENT), "TRANSIENT")
        .otherwise("OTHER")
    )


def streaks(events: DataFrame, by: str, order: str, failed: str) -> DataFrame:
    """``by, start, end, n`` of each run of failures, by gaps and islands."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(w) - F.sum(F.col(failed).cast("int")).over(w)
    runs = events.withColumn("island", island).where(F.col(failed))
    return runs.groupBy(by, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("island")


def pacing(events: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """Delay of each worker after its events: doubled on refusal, halved after a row of successes.

    A fold over the ordered events of one worker; a worker's log is one page's line each, so it is bounded
    by the page limit of a run.
    """
    log = events.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind]).alias("log"))
    start = F.struct(F.lit(0).alias("delay"), F.lit(0).alias("good"))

    def step(s: Column, k: Column) -> Column:
        good = s["good"] + 1
        half = F.floor(s["delay"] / 2).cast("int")
        slower = F.least(F.lit(POLITE_MOST), F.greatest(F.lit(POLITE_LEAST), s["delay"] * 2))
        eased = F.when(half < POLITE_LEAST, 0).otherwise(half)
        pair = lambda d, g: F.struct(d.cast("int").alias("delay"), g.cast("int").alias("good"))
        return (
            F.when(k == "REFUSED", pair(slower, F.lit(0)))
            .when((k == "OK") & (s["delay"] > 0) & (good >= POLITE_RECOVERY), pair(eased, F.lit(0)))
            .when((k == "OK") & (s["delay"] > 0), pair(s["delay"], good))
            .otherwise(s)
        )

    return log.select(by, F.aggregate("log", start, step)["delay"].alias("delay_ms"))


def counters(visits: DataFrame) -> DataFrame:
    """Counts of a run from ``outcome``: ok, failed, uninspected, truncated, deferred, file."""
    names = {"visited": ("ok", "truncated", "uninspected"), "failed": ("failed",), "uninspected": ("uninspected",), "truncated": ("truncated",), "deferred": ("deferred",), "files": ("file",)}
    return visits.agg(*[F.count_if(F.col("outcome").isin(*of)).alias(n) for n, of in names.items()])


def run_status(invalid: bool = False, error: bool = False, blocked: bool = False, stopped: bool = False, out_of_time: bool = False) -> tuple[str, int]:
    """How a run ended, with its exit code."""
    ended = [n for n, x in (("INVALID_INPUT", invalid), ("ERROR", error), ("BLOCKED", blocked), ("STOPPED", stopped), ("BUDGET", out_of_time)) if x]
    status = ended[0] if ended else "COMPLETED"
    return status, EXIT_CODES[status]


def time_budget(minutes: float) -> tuple[float, float]:
    """Soft and hard limit in seconds: the soft one ends a minute, or a fifth, earlier."""
    hard = minutes * 60
    return hard - min(60.0, hard / 5), hard
