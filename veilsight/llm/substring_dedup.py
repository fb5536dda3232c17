"""Substring dedup by level-wise doubling of word windows.

Levels double from 13 over 25 words to the full window of 50 (``levels`` halves any other width). A full
window's *anchor* at a level is the string of that level's length inside it with the least hash; at the last
level it is the window itself. Equal full windows have equal anchors at every level, so a window whose
anchor starts in documents of one id only is repeated nowhere and drops out; only what survives a level
is looked at in the next one, twice as long, until no candidates survive. Anchors of all levels below the
last come from one pass over the texts, those of a longer level kept below the shorter one they lie with,
so the levels in between read no text; the last level reads the texts that still have candidates.
Nothing but anchors (about one per 20 words at the first level), surviving windows and one text column
each for the last level and the result is moved, whatever the size of a group of copies: of equal windows in
a slice of a map task only those of the smallest document are sent on, the others being settled there,
groups are reduced map-side to a minimum, and windows meet it by a plain equi-join.

Rule: a word goes if a window of ``width`` consecutive words covers it whose word sequence also starts
in a document with a smaller ``doc_id``; windows are judged on the input. Window hashes have 128 bits.

Defined cases: a null text has no words; documents shorter than the window lose nothing; a null
``doc_id`` is neither smaller nor larger than another, so such rows lose nothing and remove nothing;
rows with one ``doc_id`` don't remove each other, and each different text among them loses its own
windows only (rows are told by ``doc_id`` and a hash of the text); an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import Windows, discard, emit, materialise, signed, sliced, sliding_min, text_hash, texts, word_hashes

WIDTH = 50

#: The first level is at most so long.
SHORTEST = 16

_ROW = ["doc_id", "t", "n_words", "s1", "s2"]
_LAST = pa.schema([(x, pa.int64()) for x in ("k1", "k2", "doc_id", "v", "run")])


def levels(width: int) -> list[int]:
    """Lengths, each about half the next one, up to the width."""
    out = [width]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(symbols: np.ndarray, width: int, length: int) -> np.ndarray:
    """For each window its anchor: the least hash among the strings of this length inside."""
    return sliding_min(Windows(symbols).of(length), width - length + 1)


def nested_type(depth: int) -> tuple[pa.DataType, str]:
    """Anchors of so many levels, each with the ones of the next level that lie with it."""
    if depth == 1:
        return pa.list_(pa.int64()), "array<long>"
    kind, ddl = nested_type(depth - 1)
    return pa.list_(pa.struct([("a", pa.int64()), ("longer", kind)])), f"array<struct<a:long,longer:{ddl}>>"


def _unfolded(tree: dict, depth: int) -> list:
    return list(tree) if depth == 1 else [{"a": a, "longer": _unfolded(x, depth - 1)} for a, x in tree.items()]


def nested(symbols: np.ndarray, width: int, below: list[int]) -> list:
    """Different anchors of the first level, each with those of the later levels of its windows."""
    lists = [signed(anchors(symbols, width, n)) for n in below]
    change = np.ones(len(lists[0]), bool)
    change[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lists])
    at = np.flatnonzero(change)
    tree: dict = {}
    for row in zip(*[x[at].tolist() for x in lists]):
        node = tree
        for h in row:
            node = node.setdefault(h, {})
    return _unfolded(tree, len(below))


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("t"))


def same_row(docs: DataFrame, other: DataFrame):
    """Rows of one ``doc_id``; ``v`` is 0 where that has one text only, else the text's hash."""
    return (docs["doc_id"] == other["doc_id"]) & ((other["v"] == 0) | (other["v"] == docs["t"]))


def _first_level(docs: DataFrame, width: int) -> DataFrame:
    below = levels(width)[:-1] or [width]
    kind, ddl = nested_type(len(below))
    schema = pa.schema([(x, pa.int64()) for x in _ROW] + [("anchors", kind)])

    def run(batches):
        for batch in sliced(batches):
            n, s1, s2, lists = [], [], [], []
            for text in texts(batch):
                ws = text.split()
                n.append(len(ws))
                whole = xxhash.xxh3_128_intdigest(b" ".join(ws))
                s1.append((whole >> 64) - (1 << 63)), s2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                lists.append(nested(word_hashes(ws), width, below) if len(ws) >= width else [])
            yield emit(schema, doc_id=batch.column(0), t=batch.column(2), n_words=n, s1=s1, s2=s2, anchors=lists)

    return _ids(docs).where("doc_id is not null").mapInArrow(run, f"doc_id long, t long, n_words long, s1 long, s2 long, anchors {ddl}")


def _opened(rows: DataFrame, column: str) -> DataFrame:
    """``doc_id, v, h, longer``: one row per anchor."""
    rows = rows.select("doc_id", "v", F.explode(column).alias("x"))
    if isinstance(rows.schema["x"].dataType, StructType):
        return rows.select("doc_id", "v", F.col("x.a").alias("h"), "x.longer")
    return rows.withColumnRenamed("x", "h")


def _shared(places: DataFrame) -> DataFrame:
    """Hashes ``h`` that start in documents of two ids or more."""
    return places.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")


def _last_level(found: DataFrame, width: int) -> DataFrame:
    """Windows at the surviving places of ``doc_id, text, v, live``.

    A run is its first place and, in the low 32 bits, its number of windows, one where there are hashes.
    Rows without ``k1`` are settled: their windows go, since the slice itself holds a smaller document
    with each of them.
    """
    length = (levels(width)[:-1] or [width])[-1]

    def run(batches):
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_numpy()
            variant = batch.column("v").to_numpy()
            live = batch.column("live")
            parts = []
            for i, text in enumerate(texts(batch)):
                w = word_hashes(text.split())
                alive = np.unique(live[i].values.to_numpy().view(np.uint64))
                a = anchors(w, width, length)
                place = np.minimum(np.searchsorted(alive, a), len(alive) - 1)
                here = np.flatnonzero(alive[place] == a)
                parts.append((Windows(w).of(width)[here], Windows(w, True).of(width)[here], np.full(len(here), i), here))
            k1, k2, row, at = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((at, row, ids[row], k2, k1))
            k1, k2, row, at = k1[order], k2[order], row[order], at[order].astype(np.int64)
            own = ids[row]
            head = np.ones(len(k1), bool)
            head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            least = own[np.maximum.accumulate(np.where(head, np.arange(len(k1)), 0))]
            sent = own == least
            yield emit(_LAST, k1=signed(k1[sent]), k2=signed(k2[sent]), doc_id=own[sent], v=variant[row[sent]], run=(at[sent] << 32) + 1)
            row, at = row[~sent], at[~sent]
            if len(row):
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(at) > 1)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(row) - 1]])
                none = [None] * len(lo)
                yield emit(_LAST, k1=none, k2=none, doc_id=ids[row[lo]], v=variant[row[lo]], run=(at[lo] << 32) + at[hi] - at[lo] + 1)

    return found.mapInArrow(run, "k1 long, k2 long, doc_id long, v long, run long")


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, v, whole, starts``: documents that lose words; ``whole`` if all of them, else the windows' places."""
    first = materialise(_first_level(docs, width), "level1")
    several = first.groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi")
    several = materialise(several.select("doc_id", F.lit(True).alias("several")), "several")
    variant = F.when(F.col("several"), F.col("t")).otherwise(F.lit(0)).cast("long").alias("v")
    long_ones = first.where(F.col("n_words") >= width).join(several, "doc_id", "left").select("*", variant)
    same = long_ones.groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    copies = long_ones.join(same, ["s1", "s2", "n_words"]).where("doc_id > least").select("doc_id", "v").distinct()
    whole = materialise(copies, "copies")

    # level by level, on what the shorter one has left
    candidates = _opened(long_ones, "anchors")
    candidates = materialise(candidates.join(_shared(candidates), "h", "left_semi"), "level")
    discard(first)
    for _ in levels(width)[1:-1]:
        if candidates.isEmpty():
            break
        longer = _opened(candidates, "longer")
        longer = materialise(longer.join(_shared(longer), "h", "left_semi"), "level")
        discard(candidates)
        candidates = longer

    starts = whole.select("doc_id", "v", F.lit(True).alias("whole"), F.lit(None).cast("array<long>").alias("starts"))
    if candidates.isEmpty():
        return starts
    live = candidates.groupBy("doc_id", "v").agg(F.collect_set("h").alias("live"))
    live = materialise(live.join(whole, ["doc_id", "v"], "left_anti"), "live")
    discard(candidates)
    d = _ids(docs)
    found = d.join(live, same_row(d, live)).select(d["doc_id"], "text", "v", "live")
    last = materialise(_last_level(found, width), "level")
    discard(live)
    least = last.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    gone = last.join(least, ["k1", "k2"]).where("doc_id > a").select("doc_id", "v", "run")
    gone = gone.unionByName(last.where("k1 is null").select("doc_id", "v", "run"))
    gone = gone.groupBy("doc_id", "v").agg(F.collect_list("run").alias("starts"))
    out = materialise(starts.unionByName(gone.select("doc_id", "v", F.lit(False).alias("whole"), "starts")), "starts")
    discard(last)
    return out


def gone_words(n: int, whole: bool | None, starts: pa.Array | None, width: int = WIDTH) -> np.ndarray:
    """Mask of the words that go."""
    if whole:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int32)
    if starts is not None and len(starts):
        at, runs = starts.to_numpy() >> 32, starts.to_numpy() & 0xFFFFFFFF
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + runs - 1 + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    d, lost = _ids(docs), removals(docs, width)
    both = d.join(lost, same_row(d, lost), "left").select(d["doc_id"], "text", "whole", "starts")

    def run(batches):
        for batch in sliced(batches):
            whole, starts = batch.column("whole").to_pylist(), batch.column("starts")
            n, lost, sha = [], [], []
            for i, text in enumerate(texts(batch)):
                ws = text.split()
                if whole[i] is None:
                    kept, gone = ws, 0
                else:
                    mask = gone_words(len(ws), whole[i], None if whole[i] else starts[i].values, width)
                    kept, gone = [w for w, g in zip(ws, mask.tolist()) if not g], int(mask.sum())
                n.append(len(ws)), lost.append(gone), sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield emit(_RESULT, doc_id=batch.column(0), n_words=n, n_removed=lost, kept_sha256=sha)

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the masked words; blanks between kept words stay, each removed run takes those after it."""
    out, at = [], 0
    place = 0
    for w, gone in zip(text.split(), mask.tolist()):
        start = text.index(w, place)
        place = start + len(w)
        if gone:
            if at is not None:
                out.append(text[at:start])
                at = None
        elif at is None:
            at = start
    if at is not None:
        out.append(text[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated words cut out of ``text`` (and ``n_chars`` counted anew, if there); all rows stay."""
    lost = removals(docs, width).select(F.col("doc_id").alias("__id"), F.col("v").alias("__v"), F.col("whole").alias("__whole"), F.col("starts").alias("__starts"))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & ((F.col("__v") == 0) | (F.col("__v") == text_hash()))
    both = docs.join(lost, same, "left").drop("__id", "__v")
    fields = docs.schema

    def run(batches):
        for batch in sliced(batches):
            whole, starts = batch.column("__whole").to_pylist(), batch.column("__starts")
            out = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if any(x is not None for x in whole):
                for i, text in enumerate(texts(batch)):
                    if whole[i] is not None:
                        n = len(text.split())
                        out[i] = cut(text, gone_words(n, whole[i], None if whole[i] else starts[i].values, width)).decode()
            cols = []
            for f in fields:
                col = batch.column(batch.schema.get_field_index(f.name))
                if f.name == "text":
                    col = pa.array(out, col.type)
                elif f.name == "n_chars":
                    col = pa.array([n if w is None else len(t) for n, w, t in zip(col.to_pylist(), whole, out)], col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return both.mapInArrow(run, fields)
