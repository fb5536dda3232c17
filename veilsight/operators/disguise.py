"""Disguised text over holders: own text first, then the text with children, dropped if a descendant is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import stored
from .hidden import FRAME, ancestors
from .verdicts import TEXT_CHECKS, verdicts_udf

#: Cheap tests in the engine before the kernel sees a text.
PREFILTERS = {
    "HOMOGLYPH": X.worth_reading,
    "JAMO": X.has_jamo,
    "ZERO_WIDTH": lambda t: X.strip_zero_width(t) != F.col(t),
    "KEYBOARD_LAYOUT": lambda t: F.col(t).rlike("(?<![A-Za-z0-9])[A-Za-z]{4,24}(?![A-Za-z0-9])"),
}


def suppress_full(found: DataFrame, above: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of found elements, those that rest on their children's text (``via_full``) go if a descendant is found."""
    key = [*FRAME, "e", *by]
    holding = above.join(found.select(*key), [*FRAME, "e"]).select(*FRAME, F.col("anc").alias("e"), *by).distinct()
    kept = found.where("via_full").join(holding, key, "left_anti")
    return found.where("not via_full").unionByName(kept)


def detect(names: list[str], holders: DataFrame, folder: str | None = None) -> DataFrame:
    """Candidates of text checks, with the columns of ``operators.hidden.detect``.

    Every different text that passes a prefilter is judged once, by all checks; only frames in which
    an element rests on its children's text are walked up.
    """
    rows = holders.select(*FRAME, "e", F.posexplode(F.array("t", "f")).alias("k", "text")).where("text <> ''")
    texts = rows.select("text").distinct()
    worth = reduce(Column.__or__, [PREFILTERS[n]("text") for n in names])
    verdicts = texts.where(worth).select("text", F.explode(verdicts_udf(names, folder)("text")).alias("v")).select("text", "v.*")
    hits = rows.join(verdicts, "text")
    first = F.min_by(F.struct("k", "text", "decoded", "method", "reasons", "keywords"), "k").alias("v")
    found = hits.groupBy(*FRAME, "e", "check").agg(first).withColumn("via_full", F.col("v.k") == 1)
    found = stored(found, "disguised")  # read three times, few rows
    full = found.where("via_full").select(*FRAME).distinct()
    chain = holders.withColumn("p", F.col("ph")).join(full, FRAME, "left_semi")
    out = suppress_full(found, ancestors(chain), ("check",))
    of = lambda k: F.coalesce(*[F.when(F.col("check") == n, TEXT_CHECKS[n][k]) for n in names]).cast("string")
    return out.select(
        *FRAME, "e", "check", of(0).alias("technique"), of(1).alias("extra_type"), X.evidence("v.text").alias("evidence_text"),
        "v.decoded", "v.method", "v.reasons", "v.keywords",
    )
