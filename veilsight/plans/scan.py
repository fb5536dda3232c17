"""The scan: stored pages or snapshots to ordered findings, report and counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import disguise, evaluate, findings, hidden
from ..operators.verdicts import TEXT_CHECKS
from ..sources import html as html_source
from ..sources.tables import stored

CORE_CHECKS = ("HOMOGLYPH", "JAMO", "TRANSPARENT", "OFFSCREEN")
EXTRA_CHECKS = ("VISIBILITY_HIDDEN", "CLIPPED", "ZERO_WIDTH", "KEYBOARD_LAYOUT")
#: Checks of the user's own: name to ``f(holders, roots, folder) -> candidates``.
OWN_CHECKS: dict[str, Callable[[DataFrame, DataFrame, str | None], DataFrame]] = {}


def check(name: str):
    """Registers a check; its candidates have the columns of ``operators.hidden.detect``."""

    def add(f):
        OWN_CHECKS[name] = f
        return f

    return add


@dataclass
class ScanResult:
    findings: DataFrame

    @property
    def core(self) -> DataFrame:
        return self.findings.where(findings.is_core())

    @property
    def extras(self) -> DataFrame:
        return self.findings.where(~findings.is_core())


def candidates(holders: DataFrame, roots: DataFrame, extras: bool = True, folder: str | None = None) -> DataFrame:
    names = [*CORE_CHECKS, *(EXTRA_CHECKS if extras else ())]
    parts = [
        disguise.detect([n for n in names if n in TEXT_CHECKS], holders, folder),
        hidden.detect([n for n in names if n in hidden.HIDDEN_CHECKS], holders, roots, folder),
        *[f(holders, roots, folder) for f in OWN_CHECKS.values()],
    ]
    order = F.array_position(F.array(*map(F.lit, [*names, *OWN_CHECKS])), F.col("check"))
    return reduce(DataFrame.unionByName, parts).withColumn("check_ord", order)


def scan_tables(holders: DataFrame, roots: DataFrame, selectors: DataFrame, extras: bool = True, folder: str | None = None) -> ScanResult:
    """Findings from holders, roots and ``page_id, frame_id, e, url, location``."""
    found = findings.locate(candidates(holders, roots, extras, folder), selectors)
    arrival = F.struct("page_id", "frame_id", "check_ord", "e")
    first = findings.collect(found.withColumn("arrival", arrival)).drop("arrival", "check", "check_ord", "frame_id", "e")
    return ScanResult(stored(first, "findings"))  # reports read it several times


def scan(pages: DataFrame, css: str = "", extras: bool = True, folder: str | None = None) -> ScanResult:
    """Findings from ``page_id, url, html``; frames are parsed once, however many checks look at them."""
    frames = html_source.read_frames(pages, css)
    return scan_tables(*html_source.tables(frames), extras=extras, folder=folder)


def report(result: ScanResult) -> DataFrame:
    """Findings with number, key, repeats over pages and advice, in no particular order."""
    rows = findings.shared_pages(findings.numbered(result.findings))
    label = F.lit("")
    for technique, name in findings.LABELS.items():
        label = F.when(F.col("technique") == technique, name).otherwise(label)
    return rows.select("id", findings.report_key().alias("review_key"), "url", "location", "technique", label.alias("technique_label"), F.col("extra_type").alias("extra_finding"), "evidence_text", "decoded", "method", "reasons", "keywords", "shared_pages", findings.action().alias("action"))


def judged(pages: DataFrame, css: str = "", extras: bool = True, folder: str | None = None, alone: Column | None = None) -> DataFrame:
    """``page, label, outcome`` of a scan over pages that carry marks; ``alone`` tells pages that count by themselves, not only in frames."""
    frames = html_source.read_frames(pages, css)
    found = scan_tables(*html_source.tables(frames), extras=extras, folder=folder).findings
    counted = pages if alone is None else pages.where(alone)
    mine = lambda df: df.join(counted.select("page_id"), "page_id", "left_semi")
    arrival = F.struct("location", "technique", "extra_type").alias("arrival")
    said = evaluate.located(mine(found).select("page_id", "location", "technique", "extra_type", arrival), frames, pages)
    return evaluate.judge(said, evaluate.expected(mine(frames)))
