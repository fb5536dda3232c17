"""Sentences put into the stored tables, which hold no Hangul: ordinary, advertising, reports, disguises."""

PLAIN = [
    "온라인카지노 가입 문의 텔레그램 @abcd123",
    "경찰, 불법 도박사이트 운영자 검거",
    "토토로 상영회 안내",
    "토토사이트 추천 안전놀이터 먹튀검증",
    "구립 도서관 여름 휴관 안내",
    "포커스 그룹 모집 문의 02-123-4567",
    "바카라 무료 쿠폰 지급 010-1234-5678",
    "카지노업 현황 통계",
    "casino bonus event www.lucky-win.com",
    "alphabet study notes for the exam",
    "bet 365 free vip code",
    "메모리슬롯 확장슬롯 점검",
    "슬롯머신 잭팟 당첨 수익 배당",
    "배팅연습 장비 대여",
    "도박 중독 치유 예방 캠페인 신고",
    "비아그라 최신 입금 bit.ly/abc12",
    "경마 장학금",
    "best escort service free event",
    "야동초 학부모 모임",
    "대포통장 근절 대책 발표 경찰 수사",
]

#: Disguised sentence, its decoded form.
DECODES = [
    ("ㅋㅏㅈㅣㄴㅗ 바로가기", "카지노 바로가기"),
    ("ㅂ.ㅏ.ㅋ.ㅏ.ㄹ.ㅏ", "바카라"),
    ("ㅋr지노", "카지노"),
    ("ㅋㅋㅋ 웃겨요", "ㅋㅋㅋ 웃겨요"),
    ("ㅂㅗㄴㅓㅅㅡ 지급", "보너스 지급"),
    ("plain text 123", "plain text 123"),
    ("값을 ㄱㅏㅂㅅ", "값을 값"),
]

#: Word in Latin keys, its Korean reading or nothing.
KEYED = [("zkwlsh", "카지노"), ("xhxh", "토토"), ("hello", None), ("qkzkfk", "바카라"), ("abc", "뮻"), ("tmffht", "슬롯"), ("QKfel", "빨디")]

#: Text, and the verdict of each check: homoglyph, jamo, zero-width, keyboard.
VERDICTS = [
    ("ㅋㅏㅈㅣㄴㅗ 가입 문의", (False, True, False, False)),
    ("сasinо bonus 가입", (True, False, False, False)),
    ("ｃａｓｉｎｏ 바로가기", (True, False, False, False)),
    ("c4sino 무료 쿠폰", (True, False, False, False)),
    ("카\u200b지\u200b노 가입 이벤트", (False, False, True, False)),
    ("zkwlsh 추천 무료", (False, False, False, True)),
    ("구립 도서관 휴관 안내", (False, False, False, False)),
    ("경찰 ㅋㅏㅈㅣㄴㅗ 단속 검거", (False, False, False, False)),
    ("ㅋㅋㅋ 재밌어요 ㅠㅠ", (False, False, False, False)),
    ("café résumé naïve", (False, False, False, False)),
    ("ㅌㅗㅌㅗ 사이트 추천 첫충", (False, True, False, False)),
    ("7r지노 가입", (True, False, False, False)),
]
