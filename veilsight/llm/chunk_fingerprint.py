"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks places where a chunk may end. Chunking is normalised: before
the mean length a place must meet the stricter mask, after it the looser one, within a least and a
greatest length. An edit moves no boundary but those near it, so texts that share passages share chunks.
A fingerprint lists the different chunk digests with their lengths (repeats added up) in order of the
digest; likeness is the containment: the shared length over the smaller of the two total lengths.

Documents meet the next one in order of ``doc_id`` without a global sort: ids are cut into ranges at
quantiles, rows are dealt out by range and sorted inside, and the first row of a range is also sent to
the range before, so only one text column is moved, once.

Defined cases: a null text is empty; an empty text has an empty fingerprint, which is like another empty
one (1) and unlike all others (0); the next of the last document is the first, of an only document
itself; equal ids are ordered by text, a null id comes first; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import mix, sliced, texts

LEAST, MEAN, MOST = 24, 64, 256
#: One place in 256 meets the strict mask, one in 16 the loose one.
STRICT, LOOSE = np.uint32(0xFF000000), np.uint32(0xF0000000)
_GEAR = (mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: bytes) -> np.ndarray:
    """The gear hash ``h = (h << 1) + G[byte]`` at each byte, 32 bits wide and so over the last 32 bytes, by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    h = gear(data)
    strict = (np.flatnonzero((h & STRICT) == 0) + 1).tolist()
    loose = (np.flatnonzero((h & LOOSE) == 0) + 1).tolist()
    out, at = [], 0
    i = j = 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST, i)
        if i < len(strict) and strict[i] < at + MEAN:
            end = strict[i]
        else:
            j = bisect_left(loose, at + MEAN, j)
            end = loose[j] if j < len(loose) and loose[j] < at + MOST else at + MOST
        if end >= n:
            break
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunk_lengths(data: bytes) -> dict[int, int]:
    """Digest to total length of the chunks with it."""
    out: dict[int, int] = {}
    at = 0
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        k = digest(data[at:end])
        out[k] = out.get(k, 0) + end - at
        at = end
    return out


def text_of(chunks: dict[int, int]) -> str:
    """The fingerprint: 16 hex digits and the length of each chunk, in order, joined by commas."""
    return ",".join([f"{k:016x}:{chunks[k]}" for k in sorted(chunks)])


def chunks_of(fingerprint: str) -> dict[int, int]:
    return {int(k, 16): int(n) for k, n in (x.split(":") for x in fingerprint.split(",") if x)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment, weighted by length: 0 to 1."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    shared = sum([min(n, b[k]) for k, n in a.items() if k in b])
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(docs: DataFrame, n: int) -> list[int]:
    """First ids of at most ``n`` ranges of like size, each of which holds rows; ``n`` numbers reach the driver."""
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted({int(x) for x in cuts})
    marked = docs.where("doc_id is not null").select("doc_id", _range_of(cuts).alias("r"))
    return [x["low"] for x in marked.groupBy("r").agg(F.min("doc_id").alias("low")).orderBy("low").collect()]


def _range_of(cuts: list[int]):
    """Number of the cuts at or below the id; null ids are in range 0."""
    if not cuts:
        return F.lit(0)
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.array_size(F.filter(F.lit(cuts).cast("array<long>"), lambda x: x <= F.col("doc_id"))))


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited text, and how near it is to the edited and to the next text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = ranges(rows.select("doc_id"), 2 * parts)
    n = max(len(low), 1)
    where = _range_of(low[1:])  # ids below the first start are null ids; range k starts at low[k]
    rows = rows.withColumn("r", where)
    starts = F.lit(low or [0]).cast("array<long>")
    # the first row of a range closes the range before; of the whole table, the last range
    null_ids = rows.where("doc_id is null").limit(1).count() > 0
    if null_ids:  # null ids come first, and their least text is the first document
        least = rows.where("doc_id is null").agg(F.min("text").alias("t")).first()["t"]
        opens = (F.col("doc_id").isNull() & (F.col("text") == F.lit(least))) | ((F.col("r") > 0) & (F.col("doc_id") == F.element_at(starts, F.col("r") + 1)))
    else:
        opens = F.col("doc_id") == F.element_at(starts, F.col("r") + 1)
    before = F.pmod(F.col("r") - 1, F.lit(n)).cast("int")
    deals = F.when(opens, F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("donor")), F.struct(before.alias("r"), F.lit(1).alias("donor"))))
    deals = deals.otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("donor"))))
    dealt = rows.select("doc_id", "text", F.explode(deals).alias("d")).select("d.r", "d.donor", "doc_id", "text")
    dealt = dealt.repartition(parts, "r").sortWithinPartitions("r", "donor", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        held = None  # r, id, text of a document that waits for the next one
        sketch = None  # its chunks, if known
        for batch in sliced(batches):
            rs, donors, ids, ts = (batch.column(k).to_pylist() for k in range(4))
            cols: list[list] = [[] for _ in _OUT]
            for r, donor, i, t in zip(rs, donors, ids, ts):
                own = chunk_lengths(t.encode())
                if held is not None and held[0] == r:
                    _, own_id, text = held
                    new = edited(text, t).encode()
                    edit = chunk_lengths(new)
                    row = (own_id, len(text), hashlib.sha256(new).hexdigest(), text_of(sketch), text_of(edit), likeness(sketch, edit), likeness(sketch, own))
                    for c, x in zip(cols, row):
                        c.append(x)
                held = None if donor else (r, i, t)
                sketch = own
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return dealt.mapInArrow(run, _DDL)
