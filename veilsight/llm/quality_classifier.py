"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are found once and written. Over the labelled rows, standardised
statistics are lifted by ``cos`` features that approximate a Gaussian kernel; each task adds up its own
normal equations, a few tasks add up those, and the driver solves one small system. The ridge score is
calibrated on labelled rows that the fit hasn't seen, by pooling adjacent violators over at most
``BINS`` sums, and read off by linear interpolation, so that order is kept and ties are rare.

Rows with ``crc32(doc_id) % 5 == 0`` are held out; of the others, remainder 4 calibrates and 1 to 3 fit.
Only the text enters a score.

Defined cases: a null text is empty, and an empty text is scored like any other; unlabelled rows are
scored; without any label to fit, scores are 0.5; a null ``doc_id`` is never labelled and not held out;
repeated labels count each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import code_points, emit, materialise, sliced, texts, word_hashes

FEATURES, BANDWIDTH, RIDGE, BINS, SUMMERS = 256, 6.0, 1.0, 512, 8
THRESHOLD = 0.3

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#*$%&|<>", "bang": b"!?", "stop": b".,;:",
    "other": b"\"'()[]{}/\\@=+-_~^`", "high": bytes(range(128, 256)),
}
STATISTICS = (
    "log_words", "log_chars", "word_length", "distinct", "top_share", "stutter", "line_words", "dup_lines", "short_words", "long_words",
    "pair_distinct", "entropy", "capital_words", "sentence_ends", *_CLASSES,
)


def statistics(text: bytes) -> list[float]:
    """Numbers that describe the whole text, none of which grows beyond a logarithm with its length."""
    ws = text.split()
    n = len(ws)
    size = max(len(text), 1)
    share = [(len(text) - len(text.translate(None, c))) / size for c in _CLASSES.values()]
    if not n:
        return [0.0] * (len(STATISTICS) - len(share)) + share
    counts = Counter(ws)
    h = word_hashes(ws)
    lengths = np.fromiter(map(len, ws), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = np.array(list(counts.values()), float) / n
    pairs = np.sort(h[1:] * np.uint64(3) + h[:-1])
    span = 7 * math.sqrt(n)  # different words grow about as the root
    firsts = b"".join([w[:1] for w in ws])
    return [
        math.log1p(n),
        math.log1p(code_points(text)),
        float(lengths.mean()),
        len(counts) / min(n, span),
        float(seen.max()),
        float((h[1:] == h[:-1]).sum()) / n,
        math.log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        float((lengths <= 3).sum()) / n,
        float((lengths >= 12).sum()) / n,
        (1 + int((pairs[1:] != pairs[:-1]).sum())) / len(pairs) if n > 1 else 1.0,
        float(-(seen * np.log(seen)).sum()) / math.log1p(n),
        (n - len(firsts.translate(None, _CLASSES["upper"]))) / n,
        sum(1 for w in ws if w[-1:] in b".!?") / n,
        *share,
    ]


_STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            yield emit(_STATS, doc_id=batch.column(0), x=[statistics(t) for t in texts(batch)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("x"))
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.cos(z @ self.frequencies + self.phases) * math.sqrt(2 / FEATURES)
        return np.concatenate([out, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators of bins in order; returns the mean place and mean value of each pool."""
    pools: list[list[float]] = []
    for a, w, t in zip(at, weight, total):
        pools.append([a * w, w, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


_SUM = pa.schema([("slot", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _summed(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """Adds ``of_batch`` up: one row a task, then by ``SUMMERS`` tasks, then on the driver, whatever the input."""

    def partial(batches):
        total, seen = np.zeros(width), 0
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
                seen += batch.num_rows
        if seen:
            yield emit(_SUM, slot=[xxhash.xxh32_intdigest(total.tobytes()) % SUMMERS], sums=[total])

    def again(batches):
        total = np.zeros(width)
        for batch in batches:
            for k in range(batch.num_rows):
                total += batch.column("sums")[k].values.to_numpy()
        yield emit(_SUM, slot=[0], sums=[total])

    ddl = "slot int, sums array<double>"
    got = rows.mapInArrow(partial, ddl).repartition(SUMMERS, "slot").mapInArrow(again, ddl).toArrow()
    return sum((x.values.to_numpy() for x in got["sums"]), np.zeros(width))


def fit(labelled: DataFrame, calibration: DataFrame, seed: int = 7) -> Model:
    """From rows of ``x`` and ``y``."""
    d, m = len(STATISTICS), FEATURES + 1
    label = lambda b: b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)

    def moments(batch):
        x = _matrix(batch)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    s = _summed(labelled, moments, 1 + 2 * d)
    rng = np.random.Generator(np.random.PCG64(seed))
    n = max(s[0], 1.0)
    mean = s[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(s[1 + d :] / n - mean * mean, 1e-6))
    none = np.zeros(0)
    model = Model(mean, scale, rng.normal(0, 1 / BANDWIDTH, (d, FEATURES)) * math.sqrt(2), rng.uniform(0, 2 * math.pi, FEATURES), np.zeros(m), none, none)
    if not s[0]:
        return model

    def equations(batch):
        z, y = model.lift(_matrix(batch)), label(batch)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    e = _summed(labelled, equations, m * m + m)
    ridge = np.eye(m) * RIDGE
    ridge[-1, -1] = 1e-6
    model.weights = np.linalg.solve(e[: m * m].reshape(m, m) + ridge, e[m * m :])

    low, high = -0.5, 1.5  # ridge scores of 0/1 labels; what lies outside falls into the end bins

    def binned(batch):
        r, y = np.clip(model.raw(_matrix(batch)), low, high), label(batch)
        k = np.minimum(((r - low) / (high - low) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(k, w, BINS) for w in (None, r, y)]).astype(float)

    b = _summed(calibration, binned, 3 * BINS).reshape(3, BINS)
    if not b[0].any():
        b = _summed(labelled, binned, 3 * BINS).reshape(3, BINS)
    used = b[0] > 0
    model.knots, model.values = isotonic(b[1][used] / b[0][used], b[0][used], b[2][used])
    return model


def remainder():
    """``crc32`` of the id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; ``labels`` has ``doc_id`` and ``quality``."""
    stats = materialise(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y is not null")
    known = known.where(remainder() != 0)
    rows = materialise(stats.join(known, "doc_id").withColumn("fold", remainder()).select("x", "y", "fold"), "labelled")
    model = fit(rows.where("fold <> 4"), rows.where("fold = 4"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch))
                yield emit(_OUT, doc_id=batch.column(0), held_out=batch.column(2), score=s, predicted=(s >= threshold).astype(np.int32))

    held = F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")
    return stats.select("doc_id", "x", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
