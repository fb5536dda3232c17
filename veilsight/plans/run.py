"""A run: a scan that ends in time, how it ended, and what it has counted."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crawl
from ..sources import html
from . import scan

#: Parts of the pages that are judged one after the other where time is limited.
PARTS = 8


@dataclass
class Run:
    """``result`` is None if nothing has been judged."""

    result: scan.ScanResult | None
    status: str
    message: str = ""
    counts: dict = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return crawl.EXIT_CODES[self.status]

    def head(self) -> dict:
        return {"status": self.status, "message": self.message, **self.counts}


class _Limit:
    """Cancels the jobs of this thread that run beyond a limit, again and again, as more may follow."""

    def __init__(self, spark, seconds: float | None):
        self.context, self.group, self.seconds = spark.sparkContext, f"scan-{uuid.uuid4().hex}", seconds
        self.over, self._done = False, threading.Event()

    def _watch(self) -> None:
        if self._done.wait(max(0.0, self.seconds)):
            return
        self.over = True
        while not self._done.wait(0.5):
            self.context.cancelJobGroup(self.group)

    def __enter__(self) -> _Limit:
        self.context.setJobGroup(self.group, "scan", interruptOnCancel=True)
        if self.seconds is not None:
            threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.context.setLocalProperty(name, None)


def _together(done: list[scan.ScanResult]) -> scan.ScanResult | None:
    """The findings of all parts, of one key that of the first page."""
    if len(done) < 2:
        return done[0] if done else None
    rows = reduce(DataFrame.unionByName, [d.findings for d in done])
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != "key"]), F.col("page_id")).alias("f")
    return scan.ScanResult(rows.groupBy("key").agg(first).select("key", "f.*").select(rows.columns))


def run(pages: DataFrame, css: str = "", extras: bool = True, folder: str | None = None, minutes: float | None = None, parts: int = PARTS) -> Run:
    """A scan within ``minutes``: after the soft limit no further part of the pages is begun, at the hard one running jobs are cancelled.

    Pages are parsed once for all parts, as frames may lie in any page. What has been judged by then is the
    result, and the status says how the run ended; an error or an interruption ends it in the same way.
    """
    began = time.monotonic()
    soft, hard = crawl.time_budget(minutes) if minutes is not None else (None, None)
    parts = parts if minutes is not None else 1
    done: list[scan.ScanResult] = []
    counts: dict = {}
    error, stopped = "", False
    with _Limit(pages.sparkSession, hard) as limit:
        try:
            frames = html.read_frames(pages, css)
            whole = frames.where("frame_id = 0").agg(F.count("*").alias("pages"), F.count_if("truncated").alias("truncated")).first()
            counts = {"pages": whole["pages"], "truncated": whole["truncated"]}
            for k in range(parts):
                if soft is not None and time.monotonic() - began >= soft:
                    break
                mine = frames.where(F.pmod(F.xxhash64("page_id"), F.lit(parts)) == k) if parts > 1 else frames
                done.append(scan.scan_tables(*html.tables(mine), extras=extras, folder=folder))
        except KeyboardInterrupt:
            stopped = True
        except PySparkException as e:  # jobs that the limit has cancelled end so too
            error = "" if limit.over else str(e).split("\n")[0]
        except Exception as e:
            if not limit.over:
                error = f"{type(e).__name__}: {e}".split("\n")[0]
    status, _ = crawl.run_status(error=bool(error), stopped=stopped, out_of_time=len(done) < parts)
    left = f"{parts - len(done)} of {parts} parts of the pages were not judged" if len(done) < parts else ""
    return Run(_together(done), status, error or left, {**counts, "parts_judged": len(done), "parts": parts})
