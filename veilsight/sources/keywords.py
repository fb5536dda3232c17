"""The built-in keyword dictionary, and its reader: word, weight, category, phrases that don't count."""

from __future__ import annotations

import os
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import to_jamo

# ---------------------------------------------------------------- fixed values
#: Korean keywords by weight and category; after a colon, phrases in which a word doesn't count.
KOREAN = (
    (3, "도박", "먹튀 먹튀검증 먹튀사이트 첫충 매충 꽁머니 꽁포 가입머니 안전놀이터 메이저놀이터 사설놀이터 토토사이트 사설토토 카지노사이트 바카라사이트 슬롯사이트 온라인카지노 라이브카지노 인터넷카지노 온라인바카라 온라인슬롯 무료슬롯 파워볼사이트 릴게임 바다이야기 총판 즉시환전 입금보너스 충전보너스 가입코드 도박사이트"),
    (2, "도박", "카지노 바카라 토토:토토로,토토리 슬롯:타임슬롯,슬롯_예약,메모리슬롯,확장슬롯 포커:포커스 홀덤 블랙잭 룰렛 파워볼 사다리게임 스포츠베팅 베팅 배팅:배팅장,배팅볼,배팅연습,배팅_연습,토스배팅 잭팟 슬롯머신 황금성"),
    (1, "도박", "섯다 고스톱 경마"),
    (3, "성인", "야동:야동초,야동리,야동마을,야동동,야동길 성인용품 성인방송 성인사이트 성인영상 성인웹툰"),
    (2, "성인", "19금"),
    (3, "성인", "야설:야설경 조건만남 출장안마 출장마사지 출장샵 섹파 원나잇 유흥알바 룸싸롱 오피사이트 휴게텔 키스방 포르노"),
    (2, "성인", "섹스"),
    (3, "의약품", "비아그라 시알리스 최음제 흥분제 물뽕"),
    (3, "금융", "대포통장 작업대출 무직자대출 무서류대출 당일대출 일수대출"),
)
#: Latin keywords likewise.
LATIN = (
    (3, "도박", "casino baccarat sportsbook"),
    (2, "도박", "toto slot slots poker holdem blackjack roulette jackpot powerball bet betting gambling"),
    (3, "성인", "porn porno"),
    (2, "성인", "xxx sex escort"),
    (3, "의약품", "viagra cialis"),
)
DEFAULT_CATEGORY, DEFAULT_WEIGHT = "기타", 2


class Keyword(NamedTuple):
    lang: str
    kw_id: int
    word: str
    weight: int
    category: str
    excludes: tuple[str, ...]
    jamo: str


SCHEMA = "lang string, kw_id int, word string, weight int, category string, excludes array<string>, jamo string"


class Dictionary(NamedTuple):
    korean: tuple[Keyword, ...]
    latin: tuple[Keyword, ...]

    def jamo(self) -> list[str]:
        return [k.jamo for k in self.korean]

    def frame(self, spark: SparkSession) -> DataFrame:
        """A hundred or so rows; joins broadcast it by its size."""
        return spark.createDataFrame([(*k[:5], list(k.excludes), k.jamo) for k in (*self.korean, *self.latin)], SCHEMA)


def _keyword(lang: str, k: int, word: str, weight: int, category: str, excludes: list[str]) -> Keyword:
    return Keyword(lang, k, word, weight, category, tuple(excludes), to_jamo(word) if lang == "ko" else "")


def _built_in(lang: str, groups) -> tuple[Keyword, ...]:
    out = []
    for weight, category, words in groups:
        for entry in words.split():
            word, _, phrases = entry.partition(":")
            out.append(_keyword(lang, len(out), word, weight, category, [p.replace("_", " ") for p in phrases.split(",") if p]))
    return tuple(out)


def parse_weight(text: str) -> int:
    try:
        return max(1, min(3, int(text.strip())))
    except ValueError:
        return DEFAULT_WEIGHT


def parse(text: str, lang: str) -> tuple[Keyword, ...]:
    """Tab-separated lines; a byte order mark, blank lines and ``#`` comments are passed over, later columns may be missing."""
    out = []
    for line in text.removeprefix("﻿").splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        cells = [c.strip() for c in line.split("\t")] + ["", "", "", ""]
        if not cells[0]:
            continue
        phrases = [p.strip().lower() for p in cells[3].split(",") if p.strip()]
        out.append(_keyword(lang, len(out), cells[0].lower(), parse_weight(cells[1]) if cells[1] else DEFAULT_WEIGHT, cells[2] or DEFAULT_CATEGORY, phrases))
    return tuple(out)


@lru_cache(maxsize=8)
def load(folder: str | None = None) -> Dictionary:
    """The dictionary; files ``keywords_ko.txt`` and ``keywords_en.txt`` in a folder take the place of the built-in lists."""

    def one(name: str, lang: str, built_in) -> tuple[Keyword, ...]:
        path = folder and os.path.join(folder, name)
        if path and os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return parse(f.read(), lang)
        return _built_in(lang, built_in)

    return Dictionary(one("keywords_ko.txt", "ko", KOREAN), one("keywords_en.txt", "en", LATIN))
