"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). The votes of
all documents are counted by pattern (at most ``3 ** len(RULES)`` of them, whatever the corpus), and
expectation-maximisation over that table estimates the class balance and each rule's accuracy under
conditional independence. A document's posterior of being good replaces "all rules must pass": each kind
of junk is looked at by two rules or more, so one bad vote alone may be outvoted and two rarely are.

Defined cases: a null text has no words; an empty table gives an empty result; repeated rows are
judged each by itself; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Windows, covered, emit, filter_rows, materialise, sliced, texts, word_chars, word_hashes

WINDOW = 8
#: Names of the rules, in the order of the votes.
RULES = (
    "length", "repetition", "symbols", "duplicate_lines", "capitals", "stutter", "word_length", "exclamation",
    "marked_words", "marked_lines", "top_word", "variety",
)

#: Most that a rule's vote on a good document is trusted.
SUREST = 0.99
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of ``width`` that occur twice or more in the text."""
    if len(hashes) <= width:
        return 0
    h = Windows(hashes).of(width)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(covered(np.flatnonzero(twice), width, len(hashes)).sum())


def holds_symbol(x: bytes) -> bool:
    return len(x.translate(None, _SYMBOLS)) < len(x)


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    upper: int
    lower: int
    stutter: int
    exclaimed: int
    marked_words: int
    marked_lines: int
    top_word: int
    different: int

    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words

    def votes(self) -> list[int]:
        def vote(value: float, good: float, bad: float) -> int:
            return 1 if value <= good else -1 if value > bad else 0

        n = max(self.n_words, 1)
        mean = self.word_chars / n
        cased = self.upper + self.lower
        return [
            1 if self.n_words >= 50 else -1 if self.n_words < 20 else 0,
            vote(self.n_repeat_words / n, 0.05, 0.3),
            vote(self.n_symbols / n, 0.05, 0.25),
            vote(self.n_dup_lines / self.n_lines, 0.2, 0.45) if self.n_lines > 4 else 0,
            vote(self.upper / cased, 0.15, 0.4) if cased else 0,
            vote(self.stutter / n, 0.05, 0.2) if self.n_words > 1 else 0,
            0 if not self.n_words else 1 if 3 <= mean <= 12 else -1 if mean < 2 or mean > 20 else 0,
            vote(self.exclaimed / n, 0.05, 0.3) if self.n_words else 0,
            vote(self.marked_words / n, 0.03, 0.2) if self.n_words else 0,
            vote(self.marked_lines / self.n_lines, 0.1, 0.5) if self.n_lines else 0,
            vote(self.top_word / n, 0.08, 0.2) if self.n_words >= 20 else 0,
            # texts have about 7 * sqrt(n) different words
            vote(-self.different / min(n, 7 * n**0.5), -0.6, -0.3) if self.n_words >= 20 else 0,
        ]


def count(text: bytes) -> Counts:
    ws = text.split()
    h = word_hashes(ws)
    seen: set[bytes] = set()
    dup = lines = marked = 0
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    for line in text.split(b"\n"):
        if not line or line.isspace() and not line.split():
            continue
        lines += 1
        marked += symbols > 0 and holds_symbol(line)
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    times = np.unique(h, return_counts=True)[1]
    return Counts(
        n_words=len(ws),
        word_chars=word_chars(text),
        n_symbols=symbols,
        n_dup_lines=dup,
        n_repeat_words=repeated_words(h),
        n_lines=lines,
        upper=len(text) - len(text.translate(None, _UPPER)),
        lower=len(text) - len(text.translate(None, _LOWER)),
        stutter=int((h[1:] == h[:-1]).sum()),
        exclaimed=text.count(b"!! ") + text.count(b"!!\n") + text.endswith(b"!!"),
        marked_words=sum(map(holds_symbol, ws)) if symbols else 0,
        marked_lines=marked,
        top_word=int(times.max(initial=0)),
        different=len(times),
    )


_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("votes", pa.list_(pa.int32()))]
)
_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, votes array<int>"
)


def rule_counts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts and votes."""

    def run(batches):
        for batch in sliced(batches):
            cs = [count(x) for x in texts(batch)]
            cols = {k: [getattr(c, k) for c in cs] for k in _OUT.names[1:-2]}
            yield emit(
                _OUT, doc_id=batch.column(0), base_failed=[c.base_failed() for c in cs], votes=[c.votes() for c in cs], **cols
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


@dataclass(frozen=True)
class LabelModel:
    """Class balance, and each rule's accuracy on good and on bad documents; abstentions carry no evidence."""

    balance: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a good vote and a bad vote of each rule add."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def prior(self) -> float:
        return math.log(self.balance / (1 - self.balance))

    def posterior(self, votes: list[int]) -> float:
        z = self.prior() + sum(w[0] if v > 0 else w[1] for w, v in zip(self.weights(), votes, strict=True) if v)
        return 1 / (1 + math.exp(-z))

    def posterior_column(self, votes: Column) -> Column:
        z = F.lit(self.prior())
        for j, (good, bad) in enumerate(self.weights()):
            z = z + F.when(votes[j] > 0, good).when(votes[j] < 0, bad).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(patterns: list[tuple[list[int], int]], rounds: int = 200) -> LabelModel:
    """EM over vote patterns with their numbers of documents.

    Rules differ by class: junk of one kind fails some rules and passes the others, so a bad vote says
    much and a good one little. All accuracies are estimated: they start at 0.95 on good and 0.3 on bad
    documents, which tells the classes apart, and keep a prior of two documents there. No rule is trusted
    beyond ``SUREST`` on good documents, as one that no good document of a corpus fails would otherwise
    outweigh all others by itself; below that it is free down to chance, and on bad ones between 0.02 and 0.98.
    """
    m, keep = len(RULES), 2.0
    good, bad, pi = np.full(m, 0.95), np.full(m, 0.3), 0.8
    if patterns:
        v = np.array([p for p, _ in patterns], float)
        n = np.array([c for _, c in patterns], float)
        yes, no = v > 0, v < 0
        for _ in range(rounds):
            z = math.log(pi / (1 - pi)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
            q = 1 / (1 + np.exp(-z))
            g, b = n * q, n * (1 - q)
            new = np.clip((g @ yes + keep * 0.95) / (g @ (yes | no) + keep), 0.5, SUREST)
            bad = np.clip((b @ no + keep * 0.3) / (b @ (yes | no) + keep), 0.02, 0.98)
            pi = float(np.clip(g.sum() / n.sum(), 0.02, 0.98))
            done = np.abs(new - good).max() < 1e-9
            good = new
            if done:
                break
    return LabelModel(pi, tuple(map(float, good)), tuple(map(float, bad)))


def fit_table(counts: DataFrame) -> LabelModel:
    rows = counts.groupBy("votes").count().collect()  # at most 3 ** len(RULES) patterns
    return fit(sorted((list(r["votes"]), int(r["count"])) for r in rows))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, ``posterior`` and ``kept`` for each document."""
    counts = materialise(rule_counts(docs), "rules")
    model = fit_table(counts)
    out = counts.withColumn("posterior", model.posterior_column(F.col("votes")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("votes")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns; texts are read twice, never shuffled."""
    votes = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    model = fit_table(rule_counts(votes))

    def keep(text: bytes) -> bool:
        c = count(text)
        return not c.base_failed() and model.posterior(c.votes()) >= threshold

    return filter_rows(docs, keep)
