"""Measurement of style: colours, contrast, and what accumulates along the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

RGB = r"^rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)(?:\s*[,/]\s*([\d.]+)(%?))?\s*\)$"


def colour(css: Column | str) -> Column:
    """Array of red, green, blue and alpha; null for what is no colour."""
    c = F.col(css) if isinstance(css, str) else css
    part = lambda k: F.regexp_extract(c, RGB, k)
    alpha = F.when(part(4) == "", 1.0).otherwise(part(4).try_cast("double") / F.when(part(5) == "%", 100.0).otherwise(1.0))
    return F.when(c == "transparent", F.array(*[F.lit(0.0)] * 4)).when(c.rlike(RGB), F.array(*[part(k).try_cast("double") for k in (1, 2, 3)], alpha))


def blend(over: Column, under: Column) -> Column:
    """A colour shown on an opaque one."""
    return F.array(*[over[k] * over[3] + under[k] * (F.lit(1.0) - over[3]) for k in range(3)])


def luminance(c: Column) -> Column:
    def channel(v: Column) -> Column:
        v = v / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return channel(c[0]) * 0.2126 + channel(c[1]) * 0.7152 + channel(c[2]) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def accumulated(nodes: DataFrame) -> DataFrame:
    """Of ``page_id, e, p, op, none`` the opacity along the tree and the nearest ``display:none`` element, for nodes under a top.

    Doubling: each node carries what accumulates from itself up to, and without, the ancestor ``to``; a round
    appends what that one carries, so the rounds are as many as the depth has binary digits. Nodes whose
    parents are missing or form a ring have no top and are left out.
    """
    mine = F.when(F.col("none"), F.col("e")).alias("none_root")
    state = stored(nodes.select("page_id", "e", F.col("p").alias("to"), F.col("op").alias("cum"), mine), "style")
    reach, n = 1, None
    while not state.where("to is not null").isEmpty():
        n = state.count() if n is None else n
        if reach > n:
            return state.where("to is null").select("page_id", "e", "cum", "none_root")
        above = state.select("page_id", F.col("e").alias("to"), F.col("to").alias("far"), F.col("cum").alias("more"), F.col("none_root").alias("other"))
        open_ = state.where("to is not null").join(above, ["page_id", "to"])
        open_ = open_.select("page_id", "e", F.col("far").alias("to"), (F.col("cum") * F.col("more")).alias("cum"), F.coalesce("none_root", "other").alias("none_root"))
        state, reach = stored(state.where("to is null").unionByName(open_), "style"), reach * 2
    return state.select("page_id", "e", "cum", "none_root")
