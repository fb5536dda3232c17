"""Arrow-batched functions over the text kernels; meant for different texts only (see ``operators.assess.by_distinct``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.keywords import load
from . import kernels as K


@F.pandas_udf(StringType())
def decode_udf(texts: pd.Series) -> pd.Series:
    return texts.map(K.decode, na_action="ignore")


@F.pandas_udf(StringType())
def compose_udf(jamo: pd.Series) -> pd.Series:
    return jamo.map(K.compose, na_action="ignore")


@F.pandas_udf(StringType())
def keyed_udf(words: pd.Series) -> pd.Series:
    return words.map(K.key_word_korean, na_action="ignore")


@F.pandas_udf(StringType())
def fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(K.fold_compat, na_action="ignore")


@F.pandas_udf(StringType())
def jamo_udf(texts: pd.Series) -> pd.Series:
    return texts.map(K.to_jamo, na_action="ignore")


def latin_udf(folder: str | None = None):
    """Latin keywords by lattice, joined by commas in order of the dictionary."""
    words = load(folder)

    def found(text: str) -> str:
        tokens = K.latin_tokens(text)
        held = {k.word for t in tokens for k in t.may_hold(words.latin) if K.latin_find(t, k.word)}
        return ",".join(k.word for k in words.latin if k.word in held)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(found, na_action="ignore")

    return run


ALIGNED = "array<struct<word:string,start:int,end:int,jamo:int,look:int,syl:int,fuzzy:int>>"


def align_udf(folder: str | None = None):
    """Places where the jamo of Korean keywords stand, as spelled or with one like jamo, and how they are written there."""
    words = load(folder)
    keywords = words.jamo()

    def found(text: str) -> list[dict]:
        each = K.align(K.jamo_units(text), keywords, True) if K.has_hangul(text) else []
        return [
            {"word": words.korean[m.keyword].word, "start": m.src_start, "end": m.src_end, "jamo": m.jamo, "look": m.look, "syl": m.syl, "fuzzy": m.fuzzy} for m in each
        ]

    @F.pandas_udf(ALIGNED)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(found, na_action="ignore")

    return run


def register_udfs(spark: SparkSession, folder: str | None = None) -> None:
    """Makes the kernels available to SQL under ``veil_`` names."""
    from ..operators.assess import assess_udf
    from ..operators.verdicts import TEXT_CHECKS, verdict_udf

    for name, udf in (("decode", decode_udf), ("compose", compose_udf), ("keyed", keyed_udf), ("fold", fold_udf), ("jamo", jamo_udf)):
        spark.udf.register(f"veil_{name}", udf)
    spark.udf.register("veil_latin", latin_udf(folder))
    spark.udf.register("veil_align", align_udf(folder))
    spark.udf.register("veil_assess", assess_udf(folder))
    for name in TEXT_CHECKS:
        spark.udf.register(f"veil_{name.lower()}", verdict_udf(name, folder))
