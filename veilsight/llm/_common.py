"""Shared plumbing of the corpus operators: byte words, rolling hashes, Arrow batches, spilled tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at a time; larger Arrow batches are cut.
SLICE_BYTES = 4 << 20

_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\r\x0b\x0c"


def words(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; ``bytes.split`` cuts at just these six blanks."""
    return text.split()


def code_points(text: bytes) -> int:
    return len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUATION)))


def word_chars(text: bytes) -> int:
    """Code points inside words."""
    return code_points(text.translate(None, _BLANKS))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, a null as empty bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(kind).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes, a longer row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


# ---------------------------------------------------------------- rolling hashes
_M = 0x9E3779B97F4A7C15
_MI = pow(_M, -1, 1 << 64)
_M2 = 0xC2B2AE3D27D4EB4F
_MI2 = pow(_M2, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = _tables[base] = np.cumprod(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that order and low bits of sums look random."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


class Windows:
    """Hashes of all windows of a sequence of 64-bit symbols, any length, from one prefix sum."""

    def __init__(self, symbols: np.ndarray, second: bool = False):
        base, self.inverse = (_M2, _MI2) if second else (_M, _MI)
        self.n = len(symbols)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * _powers(base, self.n), out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:m]) * _powers(self.inverse, m))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places that windows of ``length`` at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


# ---------------------------------------------------------------- tables
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named, as in local tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        where = "file://" + tempfile.mkdtemp(prefix="veilsight-")
        atexit.register(shutil.rmtree, where[7:], True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster
            return


atexit.register(_sweep)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of finished jobs
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Removes a written table that no later plan reads."""
    _made.pop(table.written_to, None)
    _delete(table.sparkSession, table.written_to)


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def filter_rows(docs: DataFrame, keep: Callable[[bytes], bool]) -> DataFrame:
    """Rows whose text passes, all columns as they are."""

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array([keep(x) for x in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_hash(text: str = "text") -> Column:
    """Tells texts with one ``doc_id`` apart; never 0."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return F.when(h == 0, 1).otherwise(h)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
