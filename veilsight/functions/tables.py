"""Character tables of disguises, and the strings for SQL ``translate`` made from them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# ---------------------------------------------------------------- fixed values
#: Compatibility jamo in the order of the syllable block.
ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
NUCLEI = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
CODAS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: A compound jamo and its two parts.
COMPOUNDS = "ㅘㅗㅏ ㅙㅗㅐ ㅚㅗㅣ ㅝㅜㅓ ㅞㅜㅔ ㅟㅜㅣ ㅢㅡㅣ ㄳㄱㅅ ㄵㄴㅈ ㄶㄴㅎ ㄺㄹㄱ ㄻㄹㅁ ㄼㄹㅂ ㄽㄹㅅ ㄾㄹㅌ ㄿㄹㅍ ㅀㄹㅎ ㅄㅂㅅ"
#: Jamo taken for each other in fuzzy matching.
FUZZY_FROM, FUZZY_TO = "ㅋㄲㅌㄸㅍㅃㅊㅉㅆㅔㅖ", "ㄱㄱㄷㄷㅂㅂㅈㅈㅅㅐㅒ"
#: A letter of another script and the Latin letter it looks like.
SCRIPT_PAIRS = """
аa вb сc ԁd еe ёe һh нh іi їi јj кk ӏl мm пn оo рp ԛq гr ѕs тt ѵv ѡw шw хx уy үy
Аa Вb Сc Ԁd Еe Ёe Нh Іi Їi Јj Кk Мm Оo Рp Ԛq Ѕs Тt Ѵv Ԝw Хx Уy Үy
αa βb εe ηn ιi κk νv οo ρp τt υu χx ωw γy
Αa Βb Εe Ζz Ηh Ιi Κk Μm Νn Οo Ρp Τt Υy Χx
ıi ɑa ɡg ƅb ɩi ʟl ᴀa ʙb ᴄc ᴅd ᴇe ꜰf ɢg ʜh ɪi ᴊj ᴋk ᴍm ɴn ᴏo ᴘp ʀr ꜱs ᴛt ᴜu ᴠv ᴡw ʏy ᴢz øo łl
օo սu հh
"""
#: A digit or sign and the Latin letters it may stand for.
LEET = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: A jamo and the signs that look like it.
JAMO_LOOKS = {
    "ㄱ": "7¬フ", "ㄴ": "Lし∟└レ", "ㄷ": "cC⊂匚", "ㄹ": "2zZ己", "ㅁ": "口ロ□", "ㅅ": "人入∧^ヘ", "ㅇ": "oO0○◯〇", "ㅈ": "スズ", "ㅋ": "ヲ",
    "ㅌ": "E∈", "ㅍ": "π", "ㅏ": "rト├卜", "ㅐ": "H", "ㅓ": "┤", "ㅗ": "⊥┴上", "ㅜ": "T丁┬", "ㅡ": "ー一—─", "ㅣ": "lI|1!丨ǀ∣",
}
#: Keys of the Korean keyboard and their jamo.
KEYS, KEY_JAMO = "qwertyuiopasdfghjklzxcvbnmQWERTOP", "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡㅃㅉㄸㄲㅆㅒㅖ"
#: Characters that take no room.
ZERO_WIDTH = "​‌‍⁠﻿­"
#: White space of browsers, collapsed before any analysis.
BROWSER_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
#: Signs read as a separator inside a Latin word, besides ``- _ .``.
WIDE_SEPARATORS = "－‐‑–＿．·"

# ---------------------------------------------------------------- made from them
SPLIT = {c[0]: c[1:] for c in COMPOUNDS.split()}
MERGE = {c[1:]: c[0] for c in COMPOUNDS.split()}
SCRIPT = {p[0]: p[1] for p in SCRIPT_PAIRS.split()}
LOOKS: dict[str, str] = {}
for _jamo, _signs in JAMO_LOOKS.items():
    for _c in _signs:
        LOOKS[_c] = LOOKS.get(_c, "") + _jamo
FUZZY = str.maketrans(FUZZY_FROM, FUZZY_TO)


def _jamo_forms() -> dict[str, str]:
    """Half-width and conjoining jamo; half-width vowels come in sixes, two places apart."""
    out = {chr(0xFFA1 + k): chr(0x3131 + k) for k in range(30)}
    out |= {chr(0xFFC2 + k // 6 * 8 + k % 6): chr(0x314F + k) for k in range(21)}
    out |= {chr(0x1100 + k): c for k, c in enumerate(ONSETS)}
    out |= {chr(0x1161 + k): c for k, c in enumerate(NUCLEI)}
    out |= {chr(0x11A8 + k): c for k, c in enumerate(CODAS)}
    return out


JAMO_FORMS = _jamo_forms()


def _ascii_of(form: str, code: int, length: slice) -> str:
    """What a normal form starts with, if that is an ASCII letter or digit standing as the slice asks."""
    whole = unicodedata.normalize(form, chr(code))
    return whole[0] if whole[0].isascii() and whole[0].isalnum() and len(whole) in range(*length.indices(64)) else ""


@lru_cache(maxsize=1)
def compat_table() -> dict[str, str]:
    """Characters beyond ASCII whose NFKC form is one ASCII letter or digit, with it."""
    planes = (*range(0x80, 0xD800), *range(0xE000, 0x20000))
    return {chr(x): to for x in planes if (to := _ascii_of("NFKC", x, slice(1, 2)))}


@lru_cache(maxsize=1)
def diacritic_table() -> dict[str, str]:
    """Latin letters from ``À`` to ``ɏ`` with marks that NFD takes off, with the lower-case letter under them."""
    return {chr(x): to.lower() for x in range(0xC0, 0x250) if (to := _ascii_of("NFD", x, slice(2, None))).isalpha()}


def _strings(table: dict[str, str]) -> tuple[str, str]:
    return "".join(table), "".join(table.values())


def compat_pairs() -> tuple[str, str]:
    """All characters that fold to one ASCII letter or digit, and those; for ``translate``."""
    return _strings(compat_table())


def diacritic_pairs() -> tuple[str, str]:
    return _strings(diacritic_table())


def script_pairs() -> tuple[str, str]:
    return "".join(SCRIPT), "".join(SCRIPT.values())


def jamo_pairs() -> tuple[str, str]:
    return "".join(JAMO_FORMS), "".join(JAMO_FORMS.values())


def look_pairs() -> tuple[str, str]:
    """Signs and the first jamo each may be."""
    return "".join(LOOKS), "".join(x[0] for x in LOOKS.values())
