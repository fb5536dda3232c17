import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veilsight.functions import kernels as K
from veilsight.operators import verdicts as V
from veilsight.operators.assess import assess, scan_korean
from veilsight.sources import keywords

WORDS = keywords.load()


def test_all_syllables_come_back():
    for c in map(chr, range(0xAC00, 0xD7A4)):
        assert K.compose(K.to_jamo(c)) == c


@pytest.mark.parametrize(
    "jamo, text",
    [("ㅋㅏㅈㅣㄴㅗ", "카지노"), ("ㅂㅗㄴㅓㅅㅡ", "보너스"), ("ㅋㅋㅋ", "ㅋㅋㅋ"), ("ㅏㅏ", "ㅏㅏ"), ("ㄱㅏㄳㅏ", "각사"), ("ㄸㅗㅃㅏ", "또빠"), ("", ""), ("ㄱㅏa", "가a")],
)
def test_compose(jamo, text):
    assert K.compose(jamo) == text


@pytest.mark.parametrize(
    "raw, text",
    [("ㅂ.ㅏ.ㅋ.ㅏ", "바카"), ("ㅋr지노", "카지노"), ("ㅋ   ㅏ", "ㅋ   ㅏ"), ("abc", "abc"), ("ㅋㅏ ㅈㅣ", "카 지"), ("ﾡￂ", "가")],
)
def test_decode(raw, text):
    assert K.decode(raw) == text


def test_latin_edges():
    found = lambda text, word: any(K.latin_find(t, word) for t in K.latin_tokens(text))
    assert not found("alphabet", "bet")
    assert found("ＢＥＴ365", "bet")
    assert found("c.a.s.i.n.o", "casino")
    assert found("mypoker", "poker") and not found("mypokers", "poker")
    assert not found("Привет", "bet")
    assert found("вет", "bet")


def test_reading_keeps_unmapped_letters():
    assert K.latin_tokens("caдino")[0].reading() == "caдino"


@pytest.mark.parametrize("word, text", [("zkwlsh", "카지노"), ("xhxh", "토토"), ("hello", None), ("한글", None)])
def test_keyboard(word, text):
    assert K.key_word_korean(word) == text


@given(st.text(alphabet="카지노토.- aㅋ", max_size=12))
def test_squeeze_against_a_loop(text):
    out, i = "", 0
    while i < len(text):
        out += text[i]
        i += 1
        j = i
        if K.is_syllable(text[i - 1]):
            while j < len(text) and j - i < 2 and not K.is_alnum(text[j]):
                j += 1
            if j > i and j < len(text) and K.is_syllable(text[j]):
                i = j
    assert K.squeeze_hangul(text) == out


def test_longest_hits_against_greedy():
    rng = random.Random(5)
    vocabulary = [k.word for k in WORDS.korean] + ["토토로", " ", "포커스", "가"]
    for _ in range(300):
        text = "".join(rng.choices(vocabulary, k=5))
        every = [(k.word, p, p + len(k.word)) for k in WORDS.korean for p in range(len(text)) if text.startswith(k.word, p)]
        barred = [(x, p) for k in WORDS.korean for x in k.excludes for p in range(len(text)) if text.startswith(x, p)]
        own = {k.word: k.excludes for k in WORDS.korean}
        every = [h for h in every if not any(x in own[h[0]] and p <= h[1] and h[2] <= p + len(x) for x, p in barred)]
        kept = []
        for h in sorted(every, key=lambda h: (h[1] - h[2], h[1])):
            if not any(k[1] <= h[1] and h[2] <= k[2] for k in kept):
                kept.append(h)
        assert sorted(kept) == sorted((h.keyword.word, h.start, h.end) for h in scan_korean(text, WORDS))


@pytest.mark.parametrize(
    "text, hit",
    [
        ("ㅋㅏㅈㅣㄴㅗ 가입 문의", True), ("ㅌㅗㅌㅗ사이트", True), ("ㅋㅋㅋㅋ ㅠㅠ", False), ("경찰 ㅋㅏㅈㅣㄴㅗ 단속", False), ("ㅎㅏㄴㄱㅡㄹ 공부", False),
        ("ㅂrㅋr라 쿠폰", True), ("ㅋ 오늘 ㅏ 날 ㅈ 씨 ㅣ ㄴ 좋 ㅗ", True),
    ],
)
def test_jamo(text, hit):
    assert (V.jamo(text, WORDS) is not None) == hit


@pytest.mark.parametrize(
    "text, hit",
    [
        ("сasinо 가입", True), ("ｂａｃｃａｒａｔ", True), ("c4sino", True), ("casino", False), ("café au lait", False), ("7r지노", True), ("Москва привет", False),
        ("b3t 가입 카지노 무료", True), ("b3t", False),
    ],
)
def test_homoglyph(text, hit):
    assert (V.homoglyph(text, WORDS) is not None) == hit


def test_gate():
    say = lambda t: assess(t, WORDS)
    assert say("토토사이트 추천").ad_like
    assert not say("경찰, 도박사이트 단속 검거").ad_like
    assert say("카지노").ad_like and not say("카지노 이야기가 길게 이어지는 평범한 문장으로서 다른 말이 없다").ad_like
    assert say("카지노업 현황").hidden_ad_like
    assert say("문의 010-1234-5678 바카라").contacts == ["010-1234-5678"]
    assert say("카지노 www.mois.go.kr").contacts == []
    assert say("카지노 lucky.com").contacts == ["lucky.com"]
    assert say("").letters == 0


def test_dictionary_lines(tmp_path):
    (tmp_path / "keywords_ko.txt").write_text("﻿# 주석\n가나\t9\t갈래\t가나다, ,라\n다라\tx\n\n마바\n", encoding="utf-8")
    d = keywords.load(str(tmp_path))
    assert [(k.word, k.weight, k.category, k.excludes) for k in d.korean] == [("가나", 3, "갈래", ("가나다", "라")), ("다라", 2, "기타", ()), ("마바", 2, "기타", ())]
    assert d.latin == WORDS.latin


def test_verdict_columns_say_what_the_assessment_says(spark):
    """Score, blocking and the verdicts are stated for the kernel and as columns; both agree on made-up and long texts."""
    from pyspark.sql import functions as F

    from veilsight.operators import assess as A
    from veilsight.plans.cases import DECODES, PLAIN, VERDICTS
    from veilsight.sources.keywords import load

    bits = PLAIN + [d[0] for d in DECODES] + [v[0] for v in VERDICTS]
    texts = [f"{a} {b}" for a in bits for b in bits[::3]] + [a + " 안내 문장입니다." * 20 + b for a in bits[::2] for b in bits[::5]]
    a = F.col("a")
    columns = [A.max_weight(a), A.score(a), A.blocked(a), A.ad_like(a), A.hidden_ad_like(a), A.compact(a, F.length("t"))]
    rows = A.by_distinct(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "a", A.assess_udf()).select("t", *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    words = load(None)
    for r in rows.collect():
        x = A.assess(r["t"], words)
        assert tuple(r)[1:] == (x.max_weight, x.score, x.blocked, x.ad_like, x.hidden_ad_like, x.compact(len(r["t"]))), r["t"]
