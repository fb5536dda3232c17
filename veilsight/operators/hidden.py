"""Hidden text as relations: signals, the nearest root, groups, and suppression by ancestor closure.

A root is reported if a text of its own is advertising, or if its children's or its whole text is and no
root below it is reported. The deepest qualifying root is covered by none, so "a reported descendant"
and "a qualifying descendant" are the same thing, and suppression is one anti-join against the closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence, short_number
from ..sources.tables import stored
from . import assess as A

OPACITY, ALPHA, CONTRAST, FONT_SIZE, ROOT_TEXT = 0.1, 0.1, 1.1, 1.0, 300
FRAME = ["page_id", "frame_id"]
# ---------------------------------------------------------------- fixed values
SIDES = {"left": "왼쪽", "top": "위쪽"}
OTHER_SIDE = "오른쪽"
HIDDEN_REASON = "숨겨진 글에 불법광고 문구가 있습니다."
VISIBILITY_TYPE, CLIPPED_TYPE = "VISIBILITY_HIDDEN(visibility:hidden 은닉)", "CLIPPED(clip·overflow로 잘라낸 은닉)"


def _signal(when: Column, root: Column, method: Column, reason: Column) -> Column:
    return F.when(when, F.struct(root.alias("root"), method.alias("method"), reason.alias("reason")))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def transparent() -> Column:
    """Signals of opacity, alpha and contrast, in this order."""
    op, ca, sc = F.col("op"), F.col("ca"), F.col("sc")
    v, how = short_number(op["v"]), F.coalesce(ca["how"], F.lit("color"))
    return F.array_compact(
        F.array(
            _signal(op["v"] <= OPACITY, op["r"], _text("opacity:", v), _text("투명도(opacity)를 ", v, "로 낮춰 글자가 보이지 않습니다.")),
            _signal(ca["v"] <= ALPHA, ca["r"], _text(how, ":transparent"), _text("글자색(", how, ")이 투명합니다(알파 ", short_number(ca["v"]), ").")),
            _signal(
                sc["v"] <= CONTRAST, sc["r"], _text("color:", sc["fg"], " / background:", sc["bg"]),
                _text("글자색 ", sc["fg"], "이 배경색 ", sc["bg"], "과 같아 보이지 않습니다(대비 ", short_number(sc["v"]), ")."),
            ),
        )
    )


def offscreen() -> Column:
    """Signals of ``display:none``, tiny letters and places off the screen, in this order."""
    dn, fs, off = F.col("dn"), F.col("fs"), F.col("off")
    v = short_number(fs["v"])
    side = F.lit(OTHER_SIDE)
    for how, word in SIDES.items():
        side = F.when(off["how"] == how, word).otherwise(side)
    at = _text("x=", F.floor(off["x"] + 0.5).cast("string"), "px, y=", F.floor(off["y"] + 0.5).cast("string"), "px")
    indent = F.coalesce(off["indent"], F.lit(False))
    return F.array_compact(
        F.array(
            _signal(dn.isNotNull(), dn, F.lit("display:none"), F.lit("display:none으로 화면에 그려지지 않습니다.")),
            _signal(fs["v"] <= FONT_SIZE, fs["r"], _text("font-size:", v, "px"), _text("글자 크기가 ", v, "px이라 읽을 수 없습니다.")),
            _signal(
                off.isNotNull(), off["r"], F.when(indent, _text("text-indent (", at, ")")).otherwise(_text("화면 ", side, " 밖 (", at, ")")),
                F.when(indent, _text("text-indent로 글자를 화면 ", side, " 밖으로 밀어냈습니다(", at, ").")).otherwise(_text("요소를 화면 ", side, " 밖에 배치했습니다(", at, ").")),
            ),
        )
    )


def invisible() -> Column:
    vis = F.col("vis")
    return F.array_compact(F.array(_signal(vis.isNotNull(), vis, F.lit("visibility:hidden"), F.lit("visibility:hidden으로 화면에 그려지지 않습니다."))))


def clipped() -> Column:
    clip, how = F.col("clip"), F.coalesce(F.col("clipHow"), F.lit("clip"))
    return F.array_compact(F.array(_signal(clip.isNotNull(), clip, how, _text("글자가 잘려 나가 보이지 않습니다(", how, ")."))))


HIDDEN_CHECKS = {
    "TRANSPARENT": ("TRANSPARENT", None, transparent),
    "OFFSCREEN": ("OFFSCREEN", None, offscreen),
    "VISIBILITY_HIDDEN": ("ETC", VISIBILITY_TYPE, invisible),
    "CLIPPED": ("ETC", CLIPPED_TYPE, clipped),
}


def nearest(signals: DataFrame, roots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of ``page_id, frame_id, ord, n, root, ...`` the deepest known root per holder, the first signal on ties."""
    known = signals.join(roots.select(*FRAME, F.col("e").alias("root"), "d"), [*FRAME, "root"])
    w = Window.partitionBy(*FRAME, "ord", *by).orderBy(F.col("d").desc(), "n")
    return known.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank", "d")


def closure(nodes: DataFrame) -> DataFrame:
    """``page_id, frame_id, e, anc``: every strict ancestor along ``p``, however deep, by doubling.

    After round ``k`` the pairs reach ``2 ** k`` levels up, and ``jump`` holds each node's ancestor at just that
    distance; pairs that start there continue the node's own. Each round is a join of written tables, and the
    rounds are as many as the depth has binary digits. Parents that form a ring end when a chain would have to
    be longer than there are nodes; each pair then comes once, a node of the ring being its own ancestor.
    """
    key = [*FRAME, "e"]
    pairs = stored(nodes.where("p is not null").select(*key, F.col("p").alias("anc")), "closure")
    jump, reach, n = pairs, 1, None
    out = pairs
    while not jump.isEmpty():
        n = pairs.count() if n is None else n
        if reach > n:
            return out.distinct()
        at = jump.select(*FRAME, F.col("e").alias("__e"), F.col("anc").alias("e"))
        up = lambda t: at.join(t, key).select(*FRAME, F.col("__e").alias("e"), "anc")
        more = up(out)
        out, jump, reach = stored(out.unionByName(more), "closure"), stored(up(jump), "jumps"), reach * 2
    return out


def ancestors(nodes: DataFrame) -> DataFrame:
    """The closure, from the arrays of ancestors that parsed pages come with, else by doubling."""
    if "anc" in nodes.columns:
        return nodes.select(*FRAME, "e", F.explode("anc").alias("anc"))
    return closure(nodes)


def suppress(groups: DataFrame, above: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of groups with ``own`` (a text of their own) and ``rest`` (children or whole), those that are reported."""
    key = [*FRAME, "e", *by]
    below = groups.where("own or rest").select(*key)
    covered = above.join(below, [*FRAME, "e"]).select(*FRAME, F.col("anc").alias("e"), *by).distinct()
    marked = groups.where("own or rest").join(covered.withColumn("covered", F.lit(True)), key, "left")
    return marked.withColumn("covered", F.coalesce("covered", F.lit(False))).where("own or not covered")


def _in_order(values: Column) -> Column:
    """Different values in the order of their first place."""
    return F.array_distinct(F.transform(F.array_sort(values), lambda x: x["v"]))


def _said(prefix: str, text: str) -> Column:
    return F.coalesce(F.col(f"{prefix}_ad"), F.lit(False)) & (F.coalesce(F.col(text), F.lit("")) != "")


def detect(names: list[str], holders: DataFrame, roots: DataFrame, folder: str | None = None) -> DataFrame:
    """Candidates ``page_id, frame_id, e, check, technique, extra_type, evidence_text, decoded, method, reasons, keywords``."""
    lists = F.array(*[F.struct(F.lit(n).alias("check"), HIDDEN_CHECKS[n][2]().alias("signals")) for n in names])
    rows = holders.select(*FRAME, "ord", "t", "f", F.explode(lists).alias("x")).where(F.size("x.signals") > 0)
    rows = rows.select(*FRAME, "ord", "t", "f", "x.check", F.posexplode("x.signals").alias("n", "s")).select(*FRAME, "ord", "t", "f", "check", "n", "s.*")
    near = nearest(rows, roots, ("check",)).withColumnRenamed("root", "e")
    held = near.join(roots.select(*FRAME, "e", F.col("t").alias("root_text"), F.col("n").alias("root_n"), "m"), [*FRAME, "e"]).where("m is null or m <> 1")

    # every different text is assessed once: own and full texts of holders, texts of roots; it is known by two 64-bit hashes
    texts = ("root_text", "t", "f")
    held = held.withColumn("__row", F.monotonically_increasing_id())
    held = stored(held, "held")
    each = held.select("__row", F.posexplode(F.array(*texts)).alias("k", "text")).where("text is not null")
    each = each.select("__row", "k", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    known = each.groupBy("h1", "h2").agg(F.first("text").alias("text")).withColumn("a", A.assess_udf(folder)("text"))
    verdicts = known.select(
        "h1", "h2", A.hidden_ad_like(F.col("a")).alias("ad"), F.col("a.letters").alias("letters"), F.col("a.hit_letters").alias("hit_letters"),
        F.col("a.decoded").alias("decoded"), F.concat("a.keywords", "a.contacts").alias("words"),
    )
    facts = ("ad", "letters", "hit_letters", "decoded", "words")
    judged = each.drop("text").join(verdicts, ["h1", "h2"]).groupBy("__row").agg(
        *[F.any_value(F.when(F.col("k") == k, F.col(c)), ignoreNulls=True).alias(f"{prefix}_{c}") for k, prefix in enumerate("rtf") for c in facts]
    )
    held = held.join(judged, "__row", "left").drop("__row")

    dense = (F.col("root_n") <= A.COMPACT_TEXT) | (F.col("r_hit_letters") * A.DENSE_RATIO >= F.col("r_letters"))
    own, full = _said("t", "t"), _said("f", "f")
    told = lambda p, text: F.struct("ord", F.col(text).alias("text"), F.col(f"{p}_decoded").alias("decoded"), F.col(f"{p}_words").alias("words"))
    place = lambda c: F.struct("ord", F.col(c).alias("v"))
    groups = held.where(dense).groupBy(*FRAME, "e", "check").agg(
        F.bool_or(own).alias("own"), F.bool_or(full).alias("full"),
        F.min(F.when(own, told("t", "t"))).alias("first_own"), F.min(F.when(own, told("t", "t")).when(full, told("f", "f"))).alias("first"),
        *[F.first(c).alias(c) for c in ("root_text", "root_n", "r_ad", "r_decoded", "r_words")],
        _in_order(F.collect_list(place("method"))).alias("methods"), _in_order(F.collect_list(place("reason"))).alias("reasons"),
    )
    groups = groups.withColumn("whole", (F.col("root_n") <= ROOT_TEXT) & _said("r", "root_text")).withColumn("rest", F.col("full") | F.col("whole"))
    groups = stored(groups.where("own or rest"), "hidden")  # read three times, few rows
    known = roots.join(groups.select(*FRAME).distinct(), FRAME, "left_semi")
    out = suppress(groups, ancestors(known), ("check",))
    pick = lambda f, c: F.when(F.col("whole"), F.col(c)).when(F.col("covered"), F.col(f"first_own.{f}")).otherwise(F.col(f"first.{f}"))
    of = lambda k: F.coalesce(*[F.when(F.col("check") == n, HIDDEN_CHECKS[n][k]) for n in names]).cast("string")
    return out.select(
        *FRAME, "e", "check", of(0).alias("technique"), of(1).alias("extra_type"), evidence(pick("text", "root_text")).alias("evidence_text"),
        pick("decoded", "r_decoded").alias("decoded"), F.array_join("methods", ", ").alias("method"),
        F.concat("reasons", F.array(F.lit(HIDDEN_REASON))).alias("reasons"), F.array_distinct(pick("words", "r_words")).alias("keywords"),
    )
