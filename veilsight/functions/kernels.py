"""Text kernels that no column expression can state: the Hangul automaton, lattices and their matching.

Positions count code points.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import regex

from . import tables as T

_SEPARATOR = r"[^\p{L}\p{Nd}]"
_JAMO = "[ㄱ-ㅣ]"
_RUN = regex.compile(f"{_JAMO}(?:{_SEPARATOR}{{0,2}}{_JAMO})*")
_RUN_PART = regex.compile(f"{_JAMO}+|[^ㄱ-ㅣ]+")
_ALNUM = regex.compile(r"[\p{L}\p{Nd}]")
_SQUEEZE = regex.compile(f"(?<=[가-힣]){_SEPARATOR}{{1,2}}(?=[가-힣])")
_ZERO_WIDTH = str.maketrans("", "", T.ZERO_WIDTH)
#: White space in the sense of the Java platform: no-break spaces don't count.
_SPACE = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2028\u2029\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B) if c != 0x2007}


_BLANK = "".join(sorted(_SPACE))
_BLANK_OR_WORD = regex.compile(f"([{_BLANK}]+)|[^{_BLANK}]+")
_AFTER_ALNUM = regex.compile(r"(?r)[\p{L}\p{Nd}]")
_ANY_JAMO = regex.compile("[ㄱ-ㅣ" + "".join(T.JAMO_FORMS) + "]")
_HANGUL = regex.compile("[가-힣ㄱ-ㅣ" + "".join(T.JAMO_FORMS) + "]")


def has_hangul(text: str) -> bool:
    return _HANGUL.search(text) is not None


def is_syllable(c: str) -> bool:
    return "가" <= c <= "힣"


def is_compat_jamo(c: str) -> bool:
    return "ㄱ" <= c <= "ㅣ"


def compat_jamo(c: str) -> str:
    """The compatibility jamo of any form of jamo, or nothing."""
    return c if is_compat_jamo(c) else T.JAMO_FORMS.get(c, "")


def is_alnum(c: str) -> bool:
    """Letters and decimal digits only, unlike ``str.isalnum``."""
    return unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def syllable_parts(c: str) -> str:
    """Basic jamo of a syllable."""
    rest, coda = divmod(ord(c) - 0xAC00, 28)
    onset, nucleus = divmod(rest, 21)
    parts = T.ONSETS[onset], T.NUCLEI[nucleus], T.CODAS[coda - 1] if coda else ""
    return "".join(T.SPLIT.get(p, p) for p in parts)


def to_jamo(text: str) -> str:
    """All Hangul of a text as basic jamo, everything else dropped."""
    return "".join(syllable_parts(c) if is_syllable(c) else T.SPLIT.get(j := compat_jamo(c), j) for c in text)


def _syllable(block: list[str]) -> str:
    """A block of onset, nucleus and coda as far as it goes."""
    if len(block) < 2:
        return "".join(block)
    onset, nucleus = T.ONSETS.find(block[0]), T.NUCLEI.find(block[1])
    coda = T.CODAS.index(block[2]) + 1 if len(block) > 2 else 0
    return chr(0xAC00 + (onset * 21 + nucleus) * 28 + coda) if onset >= 0 and nucleus >= 0 else block[0]


def compose(jamo: str) -> str:
    """Jamo typed one after the other as syllables; what doesn't combine stays."""
    out: list[str] = []
    block: list[str] = []  # onset, nucleus, coda

    def flush(*following: str) -> None:
        out.append(_syllable(block))
        block[:] = following

    for c in jamo:
        vowel, consonant = "ㅏ" <= c <= "ㅣ", "ㄱ" <= c <= "ㅎ"
        match len(block):
            case _ if not vowel and not consonant:
                flush()
                out.append(c)
            case 0 if vowel:
                out.append(c)
            case 0:
                block.append(c)
            case 1 if vowel and block[0] in T.ONSETS:
                block.append(c)
            case 1 if vowel:
                flush()
                out.append(c)
            case 1:
                flush(c)
            case 2 if vowel and (both := T.MERGE.get(block[1] + c)):
                block[1] = both
            case 2 if vowel:
                flush()
                out.append(c)
            case 2 if c in T.CODAS:
                block.append(c)
            case 2:
                flush(c)
            case 3 if vowel:  # the coda, or its second part, moves on as the next onset
                parts = T.SPLIT.get(block[2], block[2])
                block[2:] = parts[:-1]
                flush(parts[-1], c)
            case 3 if (both := T.MERGE.get(block[2] + c, "")) and both in T.CODAS:
                block[2] = both
            case _:
                flush(c)
    flush()
    return "".join(out)


def _read_looks(text: str) -> str:
    """All jamo as compatibility jamo, and signs beside them as the jamo they look like, onwards then backwards."""
    text = unicodedata.normalize("NFC", text)
    if not _ANY_JAMO.search(text):
        return text
    chars = list(text)
    real = [False] * (len(chars) + 2)  # one place beyond each end, so that -1 is not the last
    for m in _ANY_JAMO.finditer(text):
        chars[m.start()], real[m.start()] = compat_jamo(m.group()), True
    for order in (range(len(chars)), range(len(chars) - 1, -1, -1)):
        for i in order:
            if not real[i] and chars[i] in T.LOOKS and (real[i - 1] or real[i + 1]):
                chars[i], real[i] = T.LOOKS[chars[i]][0], True
    return "".join(chars)


def _compose_run(m: regex.Match) -> str:
    parts = _RUN_PART.findall(m.group())
    gaps = sum(len(p) for p in parts[::2]) - 1
    separated = len(parts) // 2
    out, held = [], ""
    spaced = gaps > 0 and 2 * separated > gaps
    for p in parts:
        if is_compat_jamo(p[0]):
            held += p
        elif not spaced or len(p) >= 2:
            out += [compose(held), " " if spaced else p]
            held = ""
    return "".join(out) + compose(held)


def decode(text: str) -> str:
    """Spelled-out jamo put together again."""
    return _RUN.sub(_compose_run, _read_looks(text))


def fold_compat(text: str) -> str:
    """NFKC character by character, Hangul left alone."""
    if text.isascii():
        return text
    return "".join(c if c < "\x80" or is_syllable(c) or compat_jamo(c) else unicodedata.normalize("NFKC", c) for c in text)


def squeeze_hangul(text: str) -> str:
    return _SQUEEZE.sub("", text)


def strip_zero_width(text: str) -> str:
    return text.translate(_ZERO_WIDTH)


def syllables(text: str) -> int:
    return sum(map(is_syllable, text))


def has_jamo(text: str) -> bool:
    return _ANY_JAMO.search(text) is not None


def key_word_korean(word: str) -> str | None:
    """What a Korean keyboard would have written, if it is syllables throughout."""
    jamo = [T.KEY_JAMO[k] if (k := T.KEYS.find(c)) >= 0 else T.KEY_JAMO[T.KEYS.find(c.lower())] if "A" <= c <= "Z" else "" for c in word]
    if not all(jamo):
        return None
    text = compose("".join(jamo))
    return text if all(map(is_syllable, text)) else None


# ---------------------------------------------------------------- jamo lattice
class Unit(NamedTuple):
    cands: str
    kind: str  # S of a syllable, J a jamo, L a look-alike, B a barrier
    src: int
    first: bool
    last: bool


class Aligned(NamedTuple):
    keyword: int
    start: int
    end: int
    jamo: int
    look: int
    syl: int
    fuzzy: int
    src_start: int
    src_end: int


_BARRIER = Unit("", "B", -1, True, True)


def jamo_units(text: str) -> list[Unit]:
    """The text as basic jamo with their kinds; barriers where no keyword may pass."""
    units: list[Unit] = []
    gap = 0

    def put(parts: str, kind: str, src: int) -> None:
        nonlocal gap
        if gap > 3:
            bar()
        gap = 0
        n = len(parts) - 1
        units.extend(Unit(c, kind, src, kind != "S" or k == 0, kind != "S" or k == n) for k, c in enumerate(parts))

    def bar() -> None:
        if units and units[-1].kind != "B":
            units.append(_BARRIER)

    for m in _BLANK_OR_WORD.finditer(text):
        word = m.group()
        if m.group(1):
            gap += len(word)
            continue
        if not has_hangul(word):  # its letters bar, whatever they are; what follows the last one is a gap
            if last := _AFTER_ALNUM.search(word):
                bar()
                gap = len(word) - last.end()
            else:
                gap += len(word)
            continue
        for at, c in enumerate(word, m.start()):
            if is_syllable(c):
                put(syllable_parts(c), "S", at)
            elif j := compat_jamo(c):
                put(T.SPLIT.get(j, j), "J", at)
            elif c in T.LOOKS:
                if gap > 3:
                    bar()
                gap = 0
                units.append(Unit(T.LOOKS[c], "L", at, True, True))
            elif is_alnum(c):
                bar()
                gap = 0
            else:
                gap += 1
    return units


def lone_jamo(text: str) -> list[Unit]:
    """Only what stands as single jamo."""
    return [Unit(p, "J", at, True, True) for at, c in enumerate(text) if (j := compat_jamo(c)) for p in T.SPLIT.get(j, j)]


def align(units: list[Unit], keywords: list[str], fuzzy: bool) -> list[Aligned]:
    """All places where a keyword's jamo stand, each unit offering its candidates."""
    by_first: dict[str, list[int]] = {}
    for k, word in enumerate(keywords):
        for c in {word[:1], *([x for x in T.FUZZY_FROM + T.FUZZY_TO if x.translate(T.FUZZY) == word[:1].translate(T.FUZZY)] if fuzzy else [])}:
            by_first.setdefault(c, []).append(k)
    out = []
    for start, head in enumerate(units):
        if head.kind == "B" or head.kind == "S" and not head.first:
            continue
        for k in sorted({k for c in head.cands for k in by_first.get(c, ())}):
            word = keywords[k]
            span = units[start : start + len(word)]
            if len(span) < len(word) or span[-1].kind == "S" and not span[-1].last:
                continue
            spare = int(fuzzy and len(word) >= 5)
            swaps = 0
            for u, want in zip(span, word):
                if want in u.cands:
                    continue
                swaps += 1
                if u.kind in "SB" or swaps > spare or want.translate(T.FUZZY) not in u.cands.translate(T.FUZZY):
                    break
            else:
                kinds = [u.kind for u in span]
                out.append(Aligned(k, start, start + len(word), kinds.count("J"), kinds.count("L"), kinds.count("S"), swaps, head.src, span[-1].src + 1))
    return out


def no_overlap(found: list[Aligned], order) -> list[Aligned]:
    """Longest first, each kept unless it overlaps one that is; by place."""
    kept: list[Aligned] = []
    for m in sorted(found, key=order):
        if all(m.end <= k.start or k.end <= m.start for k in kept):
            kept.append(m)
    return kept


# ---------------------------------------------------------------- Latin lattice
class Cell(NamedTuple):
    cands: str
    kind: str  # P plain, C compatibility, S script, D diacritic, L leet, N number, - separator, O other
    src: int
    raw: str


def _classify(c: str) -> tuple[str, str] | None:
    if c.isascii():
        if c.isalpha():
            return c.lower(), "P"
        if c in T.LEET:
            return T.LEET[c] + c, "L"
        return (c, "N") if c.isdigit() else (c, "-") if c in "-_." else None
    if c in T.SCRIPT:
        return T.SCRIPT[c], "S"
    if a := T.compat_table().get(c):
        return (a.lower(), "C") if a.isalpha() else (T.LEET[a] + a, "L") if a in T.LEET else (a, "N")
    if b := T.diacritic_table().get(c):
        return b, "D"
    if c in T.WIDE_SEPARATORS:
        return "-", "-"
    if unicodedata.category(c)[0] == "L" and not regex.match(r"[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}]", c):
        return "", "O"
    return None


class _Kinds(dict):
    def __missing__(self, c: str) -> tuple[str, str] | None:
        self[c] = found = _classify(c)
        return found


_KINDS = _Kinds()


@dataclass
class Token:
    start: int
    end: int
    raw: str

    @cached_property
    def cells(self) -> list[Cell]:
        return [Cell(*_KINDS[c], k, c) for k, c in enumerate(self.raw, self.start)]

    @cached_property
    def letters(self) -> frozenset[str]:
        """Every letter that some cell may be."""
        return frozenset("".join([_KINDS[c][0] for c in self.raw]))

    @cached_property
    def kinds(self) -> str:
        return "".join([_KINDS[c][1] for c in self.raw])

    def may_hold(self, keywords):
        """Those keywords whose letters all occur, in one piece if nothing is disguised."""
        if self.raw.isascii() and self.raw.isalpha():
            low = self.raw.lower()
            return [k for k in keywords if k.word in low]
        n, has = len(self.raw), self.letters.issuperset
        return [k for k in keywords if len(k.word) <= n and has(k.word)]

    def count(self, kinds: str) -> int:
        return sum(map(self.kinds.count, kinds))

    def reading(self) -> str:
        """The likeliest reading; digits and characters without a reading as they are."""
        return "".join(c.cands[-1] if c.kind in "LN" else c.cands[:1] or c.raw for c in self.cells)


class Found(NamedTuple):
    start: int
    end: int
    disguised: int
    leet: int
    leet_inside: int


def latin_tokens(text: str) -> list[Token]:
    """Runs of characters that can be read as Latin, without separators at their ends."""
    kinds = [_KINDS[c] for c in text]
    out, n, at = [], len(kinds), 0
    while at < n:
        if kinds[at] is None:
            at += 1
            continue
        start = at
        while at < n and kinds[at] is not None:
            at += 1
        end = at
        while start < at and kinds[start][1] == "-":
            start += 1
        last = at
        while last > start and kinds[last - 1][1] == "-":
            last -= 1
        if start < last:
            out.append(Token(start, end, text[start:last]))
    return out


def latin_find(token: Token, word: str) -> list[Found]:
    """Places of a keyword in a token; separators are passed over, short words need edges."""
    if len(word) > len(token.raw) or not token.letters.issuperset(word):
        return []
    cells = token.cells
    solid = [k for k, c in enumerate(cells) if c.kind != "-"]
    letter = [c.kind in "POCSD" for c in cells]
    foreign = token.count("PC") == 0
    out = []
    for at in range(len(solid) - len(word) + 1):
        span = solid[at : at + len(word)]
        if any(cells[k].kind in "NO" or want not in cells[k].cands for k, want in zip(span, word)):
            continue
        start, end = span[0], span[-1] + 1
        edges = (start == 0 or not letter[start - 1]) + (end == len(cells) or not letter[end])
        if edges < (2 if len(word) <= 3 else 1 if len(word) <= 5 else 0) or foreign and len(span) < len(solid):
            continue
        kinds = [cells[k].kind for k in span]
        out.append(Found(start, end, sum(k in "CSD" for k in kinds), kinds.count("L"), kinds[1:-1].count("L")))
    return out
