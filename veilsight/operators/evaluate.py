"""Evaluation against labelled elements and against verdicts written by hand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import html as W

#: Words of a verdict and what they mean.
VERDICTS = {"TP": "tp", "O": "tp", "정탐": "tp", "FP": "fp", "X": "fp", "오탐": "fp", "FN": "fn", "미탐": "fn"}
FORBIDDEN = ("/files/", "logout", "delete")


INTO_FRAME = " >>> "


def label(technique: str = "technique", extra_type: str = "extra_type") -> Column:
    """The technique, of an extra one with its type's name."""
    name = F.trim(F.substring_index(F.col(extra_type), "(", 1))
    return F.when(F.col(technique) == "ETC", F.concat_ws(":", F.lit("ETC"), name)).otherwise(F.col(technique))


def _look_up_udf():
    def one(text: str, n: int, wanted) -> list[dict]:
        tree = next(t for k, t in enumerate(W.trees(text or "")) if k == n)
        found = [(p, W.lookup(tree, p)) for p in wanted]
        spared = lambda e: any("data-known-fp" in a.attrs for a in (e, *e.ancestors()))
        return [{"path": p, "matches": len(es), "e": es[0].number if es else None, "known": bool(es) and spared(es[0])} for p, es in found]

    @F.pandas_udf("array<struct<path:string,matches:int,e:int,known:boolean>>")
    def run(html: pd.Series, inner: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(html, inner, paths)])

    return run


def located(findings: DataFrame, frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings ``page_id, location, technique, extra_type, arrival`` as ``judge`` takes them, each place looked up in its frame.

    Different paths into one stored frame are looked up together, however many pages show it.
    """
    cut = F.length("location") - F.length(F.substring_index("location", INTO_FRAME, -1))
    rows = findings.select(
        "page_id", "arrival", label().alias("label"), F.substring(F.col("location"), F.lit(1), cut).alias("prefix"), F.substring_index("location", INTO_FRAME, -1).alias("path")
    )
    rows = rows.join(frames.select("page_id", "prefix", "frame_id", "origin", "inner"), ["page_id", "prefix"], "left")
    asked = rows.where("origin is not null").groupBy("origin", "inner").agg(F.collect_set("path").alias("paths"))
    there = asked.join(pages.select(F.col("page_id").alias("origin"), "html"), "origin").select("origin", "inner", F.explode(_look_up_udf()("html", "inner", "paths")).alias("v"))
    found = rows.join(there.select("origin", "inner", "v.*"), ["origin", "inner", "path"], "left")
    element = F.when(F.col("matches") == 1, F.concat_ws(":", "frame_id", "e"))
    return found.select(F.col("page_id").alias("page"), element.alias("element"), "label", "arrival", F.coalesce("matches", F.lit(0)).alias("matches"), "known")


def expected(frames: DataFrame) -> DataFrame:
    """``page, element, label`` of all marks."""
    each = frames.select("page_id", "frame_id", F.explode("marks").alias("m")).select("page_id", "frame_id", "m.e", F.explode("m.labels").alias("label"))
    return each.select(F.col("page_id").alias("page"), F.concat_ws(":", "frame_id", "e").alias("element"), "label")


def judge(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """``page, label, outcome``: tp, fp, known_fp or fn.

    ``findings`` has ``page, element, label, arrival, matches, known``: the element that its place leads
    to, of ``matches`` ones; ``truth`` has ``page, element, label``. Only the first finding of an element
    and label is right, and places that lead to none or many are wrong.
    """
    one = findings.where("matches = 1 and element is not null")
    order = Window.partitionBy("page", "element", "label").orderBy("arrival")
    ranked = one.withColumn("n", F.row_number().over(order))
    both = ranked.join(truth.select("page", "element", "label").distinct().withColumn("wanted", F.lit(True)), ["page", "element", "label"], "full")
    outcome = (
        F.when(F.col("n").isNull(), "fn").when(F.col("wanted") & (F.col("n") == 1), "tp").when(F.col("wanted").isNull() & F.coalesce("known", F.lit(False)), "known_fp").otherwise("fp")
    )
    judged = both.select("page", "label", outcome.alias("outcome"))
    return judged.unionByName(findings.where("not (matches = 1 and element is not null)").select("page", "label", F.lit("fp").alias("outcome")))


def ratio(part: Column, whole: Column) -> Column:
    """1 where there is nothing to measure."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def metrics(judged: DataFrame) -> DataFrame:
    """Counts, precision and recall per technique (extra types together), and in total over the core ones."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    kinds = judged.withColumn("label", F.substring_index("label", ":", 1)).withColumn("core", F.col("label") != "ETC")
    each = kinds.withColumn("names", F.when(F.col("core"), F.array("label", F.lit("TOTAL"))).otherwise(F.array("label")))
    sums = each.select(F.explode("names").alias("label"), "outcome").groupBy("label").agg(
        count("tp").alias("tp"), count("fp", "known_fp").alias("fp"), count("fn").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))


def by_hand(verdicts: DataFrame) -> DataFrame:
    """Counts per technique of verdicts written by hand; what is no known word is unjudged."""
    v = F.upper(F.trim("verdict"))
    meaning = F.lit("unjudged")
    for word, name in VERDICTS.items():
        meaning = F.when(v == word, name).otherwise(meaning)
    named = verdicts.withColumn("__m", F.coalesce(F.when(F.col("verdict").isNull(), "unjudged"), meaning))
    return named.groupBy("technique").agg(*[F.count_if(F.col("__m") == m).alias(m) for m in ("tp", "fp", "fn", "unjudged")])


def forbidden_requests(requests: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for part in FORBIDDEN:
        bad = bad | F.contains("path", F.lit(part))
    return requests.where(bad).select("path").distinct()


def history_row(metrics_df: DataFrame, labels: list[str]) -> DataFrame:
    """One wide row: tp, fp and fn of each label."""
    wide = metrics_df.groupBy().pivot("label", labels).agg(F.first("tp").alias("tp"), F.first("fp").alias("fp"), F.first("fn").alias("fn"))
    return wide.select(*[F.coalesce(F.col(f"{x}_{k}"), F.lit(0)).alias(f"{x.lower()}_{k}") for x in labels for k in ("tp", "fp", "fn")])
