"""Findings: first of each kind, order, numbers, repeats over pages, advice, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.tables import stored

CORE = ("HOMOGLYPH", "JAMO", "TRANSPARENT", "OFFSCREEN")
EXTRA, SHARED_PAGES = "ETC", 2
# ---------------------------------------------------------------- fixed values
LABELS = {"HOMOGLYPH": "닮은꼴 글자 위장", "JAMO": "자모 분해", "TRANSPARENT": "투명 텍스트", "OFFSCREEN": "화면 밖 은닉", "ETC": "추가 제안"}
ADVICE = {
    "HOMOGLYPH": "닮은꼴 글자로 금칙어 필터를 피한 문구입니다. 게시글·댓글이면 삭제하고 작성 계정·IP를 차단하세요. 금칙어 필터에 유니코드 정규화(NFKC)와 닮은꼴 글자 치환을 적용하면 재발을 줄일 수 있습니다.",
    "JAMO": "자음·모음을 풀어 써서 금칙어 필터를 피한 문구입니다. 게시글이면 삭제하고 작성 계정·IP를 차단하세요.",
    "": "화면에 보이지 않게 심어 둔 문구입니다. 게시글 본문이면 삭제하고 작성 계정·IP를 차단하세요. 게시글이 아닌 곳(템플릿·스크립트)에 있다면 웹셸·관리자 계정 탈취로 인한 변조일 수 있으니 소스 변경 이력과 서버를 점검하세요.",
}
SHARED_ADVICE = " 같은 문구가 여러 페이지의 같은 위치에 반복됩니다. 머리글·바닥글 등 공통 영역(템플릿)이 변조되었을 가능성이 높습니다."


def kind(technique: str = "technique", extra_type: str = "extra_type") -> Column:
    return F.concat_ws(":", F.col(technique), F.col(extra_type))


def key() -> Column:
    """What makes two findings the same one: page, place and kind."""
    return F.concat_ws("\n", U.key("url"), F.col("location"), kind())


def collect(candidates: DataFrame) -> DataFrame:
    """The first arrival of each key; rows without a page, a place or a technique go."""
    whole = candidates.where("url is not null and technique is not null and length(trim(location)) > 0").withColumn("key", key())
    first = F.min_by(F.struct(*[F.col(c) for c in whole.columns if c != "key"]), F.col("arrival")).alias("f")
    return whole.groupBy("key").agg(first).select("key", "f.*")


def is_core() -> Column:
    return F.col("technique") != EXTRA


def ordered() -> list[Column]:
    return [U.key("url"), F.col("location"), F.col("technique"), F.coalesce("extra_type", F.lit(""))]


def numbered(findings: DataFrame) -> DataFrame:
    """``id`` counts core and extra findings apart, in report order.

    Numbers in order need one order: rows are dealt out by range, sorted, and written once with their
    partition and place, so that counting and numbering read the same ranges; a partition's numbers begin
    after the sums of those before, so no task holds all rows.
    """
    rows = findings.withColumn("core", is_core())
    n = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col("core"), *ordered()).sortWithinPartitions(F.col("core"), *ordered())
    placed = stored(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "ranges")
    sums = placed.groupBy("__p", "core").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = Window.partitionBy("core").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    number = F.col("__before") + F.col("__i") - F.col("__first") + 1
    return placed.join(sums, ["__p", "core"]).withColumn("id", F.format_string("f_%03d", number)).drop("__p", "__i", "__before", "__first")


def report_key() -> Column:
    """Short identity of a finding over runs."""
    return F.substring(F.sha1(key()), 1, 16)


def shared_pages(findings: DataFrame) -> DataFrame:
    """On how many pages the same text stands in the same place by the same technique; 0 if on one only."""
    shape = ["technique", "extra_type", "location", "evidence_text"]
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shape]
    pages = findings.groupBy(*shape).agg(F.count_distinct("url").alias("pages"))
    pages = pages.select(*[F.col(c).alias(f"__{c}") for c in shape], F.when(F.col("pages") >= SHARED_PAGES, F.col("pages")).otherwise(0).cast("int").alias("shared_pages"))
    joined = same[0] & same[1] & same[2] & same[3]
    return findings.join(pages, joined).drop(*[f"__{c}" for c in shape])


def action() -> Column:
    base = F.lit(ADVICE[""])
    for technique in ("HOMOGLYPH", "JAMO"):
        base = F.when(F.col("technique") == technique, ADVICE[technique]).otherwise(base)
    return F.concat(base, F.when(F.col("shared_pages") >= SHARED_PAGES, SHARED_ADVICE).otherwise(""))


def locate(candidates: DataFrame, selectors: DataFrame) -> DataFrame:
    """Candidates with the selector of their element; those without one go."""
    return candidates.join(selectors.where("location is not null"), ["page_id", "frame_id", "e"])


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("technique").agg(F.count("*").alias("n"))
