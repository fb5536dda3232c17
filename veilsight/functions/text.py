"""Text functions as column expressions: folding by table, prefilters, squeezing, evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

EVIDENCE, OWN_TEXT, FULL_TEXT = 500, 2000, 600
#: Pages are sent on only if their text could be disguised.
INTERESTING = r"[^\x00-\x7F가-힣]|[A-Za-z][0-9@$!]|[0-9@$!][A-Za-z]|[가-힣][A-Za-z0-9|!^]|[A-Za-z0-9|!^][가-힣]|[A-Za-z]{4}"
ALNUM = r"[\p{L}\p{Nd}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def collapse_space(text: Column | str) -> Column:
    """Runs of white space, as browsers see it, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), _class(T.BROWSER_SPACE) + "+", " "))


def to_compat_jamo(text: Column | str) -> Column:
    return F.translate(_c(text), *T.jamo_pairs())


def fuzzy_class(jamo: Column | str) -> Column:
    return F.translate(_c(jamo), T.FUZZY_FROM, T.FUZZY_TO)


def fold_script(text: Column | str) -> Column:
    return F.translate(_c(text), *T.script_pairs())


def fold_width(text: Column | str) -> Column:
    """Characters that fold to one ASCII letter or digit."""
    return F.translate(_c(text), *T.compat_pairs())


def fold_diacritics(text: Column | str) -> Column:
    return F.translate(_c(text), *T.diacritic_pairs())


def looks_to_jamo(text: Column | str) -> Column:
    return F.translate(_c(text), *T.look_pairs())


def keys_to_jamo(word: Column | str) -> Column:
    """Keys of the Korean keyboard as jamo; capitals without a jamo of their own as their small letters."""
    more = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in T.KEYS)
    return F.translate(_c(word), T.KEYS + more, T.KEY_JAMO + "".join(T.KEY_JAMO[T.KEYS.index(c.lower())] for c in more))


def strip_zero_width(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), _class(T.ZERO_WIDTH), "")


def squeeze_hangul(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?<=[가-힣])[^\p{L}\p{Nd}]{1,2}(?=[가-힣])", "")


def has_jamo(text: Column | str) -> Column:
    forms = "[ㄱ-ㅣ\\x{1100}-\\x{1112}\\x{1161}-\\x{1175}\\x{11A8}-\\x{11C2}\\x{FFA1}-\\x{FFBE}\\x{FFC2}-\\x{FFC7}\\x{FFCA}-\\x{FFCF}\\x{FFD2}-\\x{FFD7}\\x{FFDA}-\\x{FFDC}]"
    return _c(text).rlike(forms)


def worth_reading(text: Column | str) -> Column:
    """Whether look-alikes can be in it at all."""
    return _c(text).rlike(r"[A-Za-z0-9]|[^\x00-\x7F가-힣\s\x{A0}\x{2000}-\x{200A}\x{3000}]")


def interesting(text: Column | str) -> Column:
    return _c(text).rlike(INTERESTING)


def lone_jamo(text: Column | str) -> Column:
    """Single jamo of a text, compounds taken apart, everything else dropped."""
    out = F.regexp_replace(to_compat_jamo(text), "[^ㄱ-ㅣ]", "")
    for one, two in T.SPLIT.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def count_letters(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(ALNUM))


def count_syllables(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit("[가-힣]"))


def evidence(text: Column | str) -> Column:
    return F.substring(_c(text), 1, EVIDENCE)


def short_number(v: Column | str) -> Column:
    """Three decimals at most, without closing zeros."""
    s = F.format_string("%.3f", _c(v).cast("double"))
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
