"""License scans by template markup compiled to token automata.

A template is written in words with two kinds of markup: ``[ ... ]`` may be absent, and ``{n}`` stands
for any words, ``n`` at most. Compilation gives a nondeterministic automaton over tokens; a text is
accepted from a place on if every mandatory word follows exactly, in order, with nothing else between.
A template is tried only in texts that hold all its mandatory words, and at places of words it may begin with.
The wordings, whole licences, their notices and short forms, are in ``license_texts``.
Phrases are counted at all places besides.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased: letters, digits and
everything beyond ASCII.

Defined cases: a null text is empty and has no words, labels or places, and score 0; repeated rows are
scanned each by itself; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import emit, sliced, texts
from .license_texts import TEMPLATES

#: Phrase and label of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

BASE_STRENGTH = 0.6

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD_BYTES else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


#: Brackets, numbers of free words, and what stands between.
_MARKUP = re.compile(r"[\[\]]|\{\d+\}|[^\[\]{}]+")


@dataclass(frozen=True)
class Automaton:
    """States are numbered; ``step[s]`` lists (word or None for any, next state), ``free[s]`` the states reached for nothing."""

    step: tuple[tuple[tuple[bytes | None, int], ...], ...]
    free: tuple[frozenset[int], ...]
    final: int
    mandatory: tuple[bytes, ...]

    @property
    def starts(self) -> frozenset[bytes] | None:
        """Words that a match may begin with; none if it may begin with any."""
        words = {w for s in self.free[0] for w, _ in self.step[s]}
        return None if None in words else frozenset(words)

    @property
    def rarest(self) -> bytes:
        return max(self.mandatory, key=len)

    def accepts(self, words: list[bytes], at: int = 0) -> bool:
        """Whether a match starts at this word."""
        states = self.free[0]
        while self.final not in states:
            if at == len(words):
                return False
            word, at = words[at], at + 1
            states = frozenset().union(*[self.free[t] for s in states for w, t in self.step[s] if w is None or w == word])
            if not states:
                return False
        return True


def compile_template(template: str) -> Automaton:
    step: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[set[int]] = [set()]
    opened: list[int] = []
    mandatory: list[bytes] = []

    def new(word: bytes | None) -> None:
        step[-1].append((word, len(step)))
        step.append([])
        free.append(set())

    for part in _MARKUP.findall(template):
        if part == "[":
            opened.append(len(step) - 1)
        elif part == "]":
            free[opened.pop()].add(len(step) - 1)
        elif part[0] == "{":
            start = len(step) - 1
            for _ in range(int(part[1:-1])):
                new(None)
            for s in range(start, len(step) - 1):
                free[s].add(len(step) - 1)
        else:
            for word in tokens(part.encode()):
                new(word)
                if not opened:
                    mandatory.append(word)
    if opened:
        raise ValueError(f"unclosed optional part: {template}")
    # an optional part may start where another one ends: close over free steps
    closed: list[frozenset[int]] = []
    for s in range(len(step)):
        seen, todo = {s}, [s]
        while todo:
            for t in free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        closed.append(frozenset(seen))
    return Automaton(tuple(map(tuple, step)), tuple(closed), len(step) - 1, tuple(mandatory))


_AUTOMATA = tuple((label, strength, a, a.starts) for label, strength, a in ((n, k, compile_template(t)) for n, k, t in TEMPLATES))
_PHRASE_WORDS = tuple((p.encode().split(), label) for p, label in PHRASES)


def places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


def starting(words: list[bytes], starts: frozenset[bytes] | None) -> list[int]:
    if starts is None:
        return list(range(len(words)))
    if len(starts) == 1:
        return places(words, *starts)
    return [k for k, w in enumerate(words) if w in starts]


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """Number of words and of base places, first and last of them, base labels, all labels, score."""
    low = text.translate(_TABLE)
    words = low.split()
    starts: list[int] = []
    base: set[str] = set()
    if b"license" in low:
        for at in places(words, b"license"):
            for phrase, label in _PHRASE_WORDS:
                k = at - len(phrase) + 1
                if k >= 0 and words[k : at + 1] == phrase:
                    starts.append(k)
                    base.add(label)
    found = {label: BASE_STRENGTH for label in base}
    for label, strength, a, starts_of in _AUTOMATA:
        if a.rarest in low and all(w in low for w in a.mandatory) and found.get(label, 0.0) < strength:
            if any(a.accepts(words, k) for k in starting(words, starts_of)):
                found[label] = strength
    miss = 1.0
    for strength in sorted(found.values()):
        miss *= 1 - strength
    ordered = lambda x: ",".join(sorted(x))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ordered(base), ordered(found), round(1 - miss, 9))


_OUT = pa.schema(
    [("doc_id", pa.int64())] + [(x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def licenses(docs: DataFrame) -> DataFrame:
    """The scan of every row; nothing is shuffled."""

    def run(batches):
        for batch in sliced(batches):
            cols = zip(*[scan(x) for x in texts(batch)])
            yield emit(_OUT, doc_id=batch.column(0), **dict(zip(_OUT.names[1:], cols)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)
