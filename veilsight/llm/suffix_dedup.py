"""Suffix-array dedup of byte strings with a logarithmic index family.

A byte goes if a ``width``-byte string that covers it also starts anywhere else, in the same document or
another one. Only places that can have a partner are indexed: every string has an anchor, the 32-byte
string inside with the least hash; equal strings have equal anchors, so strings whose anchor occurs once
in the corpus are passed by. The rest is dealt out by anchor as segments, and each task keeps one index
family over all that it is given: an arriving batch gets its suffix array (suffixes cut at ``width``), which
finds repeats inside the batch, is merge-scanned against the levels there are, and becomes a level; levels
of like size merge, so a batch meets a logarithmic number of them. A level is a text and the places of its
different strings in suffix order, with no more than the heads of strings copied, so equal strings are held once however often
they occur; the number of tasks grows with the segments, so an index is bounded. An anchor beyond ``HOT``
places is dealt out by the string's distance from it as well.
Segments that are equal within a slice of a map task are settled there, and one of them is sent on for
the others, so a line or passage that a third of the documents hold, or one text holds thousands of
times, is not sent thousands of times.

Exact copies of whole texts need no index: all but very short ones go whole, and one of them stands for
the others.

Defined cases: a null text is empty; texts shorter than the width lose nothing; repeated rows are copies
of each other; a null ``doc_id`` is a document like any other; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Windows, emit, materialise, mix, sliced, sliding_min, texts

WIDTH, GRAM = 200, 32
HOT, CLASS = 4096, 8
#: Windows in one batch of an index family, and longest segment in windows.
BATCH_WINDOWS, SEGMENT = 1 << 17, 512
#: Bytes of each string that a level holds beside its text.
HEAD = 16
#: Segment bytes that one task indexes; an anchor's strings take twice the width at most.
INDEX_BYTES = 32 << 20
_PLACE_BITS = 22
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_CHUNK = (1 << _PLACE_BITS) - 4096
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def chunks(text: bytes, width: int):
    """``(base, part)`` so that each string of the text starts in one part."""
    for base in range(0, max(len(text) - width + 1, 0), _CHUNK):
        yield base, text[base : base + _CHUNK + width - 1]


def anchored(part: bytes, width: int, gram: int = GRAM) -> np.ndarray:
    """For each string of a part: its anchor's hash, and in the low bits the anchor's place."""
    h = Windows(_BYTES[np.frombuffer(part, np.uint8)]).of(gram)
    h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    return sliding_min(h, width - gram + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


_FIRST = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_bytes", pa.int64()), ("anchors", pa.list_(pa.int64()))])
_SEGMENTS = pa.schema([("key", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("met", pa.bool_()), ("seg", pa.binary())])
_SPANS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _first(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            n, lists = [], []
            for text in texts(batch):
                own = [np.unique(anchored(p, width)) & ~_PLACE for _, p in chunks(text, width)]
                n.append(len(text)), lists.append(np.concatenate(own).view(np.int64) if own else [])
            yield emit(_FIRST, doc_id=batch.column(0), t1=batch.column(2), t2=batch.column(3), n_bytes=n, anchors=lists)

    return _keyed(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, n_bytes long, anchors array<long>")


def _segments(found: DataFrame, width: int) -> DataFrame:
    """Segments of the strings whose anchors live, from ``text, t1, t2, live, hot``.

    A row without ``seg`` is a settled span of ``size`` bytes; ``met`` marks a segment that stands for
    others too.
    """

    def run(batches):
        for batch in sliced(batches):
            t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            live, hot = batch.column("live"), batch.column("hot")
            same: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for i, text in enumerate(texts(batch)):
                alive = live[i].values.to_numpy().view(np.uint64)
                order = np.argsort(alive)
                alive, warm = alive[order], hot[i].values.to_numpy(zero_copy_only=False)[order]
                for base, part in chunks(text, width):
                    m = anchored(part, width)
                    h = m & ~_PLACE
                    at = np.minimum(np.searchsorted(alive, h), len(alive) - 1)
                    here = np.flatnonzero(alive[at] == h)
                    if not len(here):
                        continue
                    away = ((m[here] & _PLACE).astype(np.int64) - here) // CLASS
                    cls = np.where(warm[at[here]], away + 1, 0)
                    key = mix(h[here] + cls.astype(np.uint64)).view(np.int64)
                    cut = np.flatnonzero((np.diff(here) != 1) | (np.diff(key) != 0)) + 1
                    lo = np.concatenate([[0], cut])
                    hi = np.concatenate([cut, [len(here)]])
                    for p, q in zip(lo.tolist(), hi.tolist()):
                        for s in range(p, q, SEGMENT):
                            e = min(s + SEGMENT, q)
                            w = int(here[s])
                            same.setdefault((int(key[s]), part[w : w + (e - s) + width - 1]), []).append((i, base + w))
            rows, settled = [], {}
            for (key, seg), places in same.items():
                i, start = places[0]
                rows.append((key, t1[i], t2[i], start, len(seg), len(places) > 1, seg))
                if len(places) > 1:
                    for i, start in places:
                        settled.setdefault(i, []).append((start, start + len(seg)))
            for i, spans in settled.items():
                lo, hi = np.array(spans).T
                rows += [(t1[i] ^ a, t1[i], t2[i], a, b - a, True, None) for a, b in union_of(lo, hi)]
            if rows:
                yield emit(_SEGMENTS, **dict(zip(_SEGMENTS.names, zip(*rows))))

    return found.mapInArrow(run, "key long, t1 long, t2 long, start long, size long, met boolean, seg binary")


def windows_of(text: np.ndarray, width: int) -> np.ndarray:
    """All strings of a text as a view, nothing copied."""
    return np.ndarray((len(text) - width + 1,), f"S{width}", text, strides=(1,))


@dataclass
class Level:
    """A suffix array: ``order`` lists the places of different strings of ``text`` in order, ``met`` those seen twice.

    The text is segments end to end, which begin at ``base`` and stand at ``start`` in the texts ``t1, t2``.
    """

    width: int
    text: np.ndarray
    base: np.ndarray
    t1: np.ndarray
    t2: np.ndarray
    start: np.ndarray
    order: np.ndarray
    met: np.ndarray

    def __post_init__(self) -> None:
        self.head = windows_of(self.text, min(HEAD, self.width))[self.order]

    def strings(self, a: int, b: int) -> np.ndarray:
        return windows_of(self.text, self.width)[self.order[a:b]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each of the sorted strings belongs in the order: first by the heads of strings, then among equal heads."""
        heads = keys.astype(self.head.dtype)
        lo, hi = np.searchsorted(self.head, heads, "left"), np.searchsorted(self.head, heads, "right")
        view, open_ = windows_of(self.text, self.width), np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = view[self.order[mid]] < keys[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans ``t1, t2, lo, hi`` of these entries of the order, those of neighbouring places in one."""
        place = np.sort(self.order[at])
        seg = np.searchsorted(self.base, place, "right") - 1
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(seg) != 0)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(place) - 1]])
        seg = seg[lo]
        start = self.start[seg] - self.base[seg]
        return self.t1[seg], self.t2[seg], start + place[lo], start + place[hi] + self.width

    def merged(self, other: Level, step: int = 1 << 16) -> Level:
        """Both, which share no string: the lesser order is merged into the greater one."""
        if len(other.order) > len(self.order):
            return other.merged(self, step)
        at = np.concatenate([self.find(other.strings(a, a + step)) for a in range(0, len(other.order), step)])
        both = lambda f: np.concatenate([getattr(self, f), getattr(other, f)])
        shift = len(self.text)
        return Level(
            self.width, both("text"), np.concatenate([self.base, other.base + shift]), both("t1"), both("t2"), both("start"),
            np.insert(self.order, at, other.order + shift), np.insert(self.met, at, other.met),
        )


class Family:
    """Levels of geometrically growing size, disjoint as sets of strings."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.scans = self.merges = 0

    def scan(self, keys: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Which of the sorted keys some level holds, and the spans of held occurrences met for the first time."""
        found = np.zeros(len(keys), bool)
        first = []
        for lv in self.levels:
            self.scans += 1
            open_ = np.flatnonzero(~found)
            if not len(open_):
                break
            sought = keys if len(open_) == len(keys) else keys[open_]
            at = np.minimum(lv.find(sought), len(lv.order) - 1)
            same = windows_of(lv.text, lv.width)[lv.order[at]] == sought
            found[open_[same]] = True
            at = at[same]
            at = at[~lv.met[at]]
            lv.met[at] = True
            if len(at):
                first.append(lv.spans(at))
        return found, first

    def add(self, level: Level) -> None:
        if not len(level.order):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-1].order) * 2 > len(self.levels[-2].order):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)
            self.merges += 1


class Task:
    """One task's index family, over batches of segments as they come."""

    def __init__(self, width: int):
        self.width, self.family = width, Family()

    def batch(self, t1: np.ndarray, t2: np.ndarray, start: np.ndarray, known: np.ndarray, segs: list[bytes]):
        """Spans ``t1, t2, lo, hi`` that the batch settles; ``known`` rows stand for settled ones and are told as well."""
        w = self.width
        size = np.fromiter(map(len, segs), np.int64, len(segs)) - w + 1
        unique: dict[bytes, int] = {}
        group = np.array([unique.setdefault(s, len(unique)) for s in segs])
        times = np.bincount(group) + np.bincount(group, known)
        # segments that occur more than once go whole
        many = times[group] > 1
        out = [(t1[many], t2[many], start[many], start[many] + size[many] + w - 1)]

        row = np.zeros(len(unique), np.int64)
        row[group[::-1]] = np.arange(len(segs))[::-1]  # the first row of each different segment
        text = np.frombuffer(b"".join(unique), np.uint8)
        n = size[row]
        base = np.concatenate([[0], np.cumsum(n + w - 1)[:-1]])
        own = np.repeat(np.arange(len(row)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        keys = windows_of(text, w)[base[own] + step]
        order = np.argsort(keys, kind="stable")  # the batch's suffix array
        ordered = keys[order]
        twin = ordered[1:] == ordered[:-1]
        met = np.zeros(len(keys), bool)
        met[order[1:][twin]] = True
        met[order[:-1][twin]] = True
        met |= times[own] > 1
        single = np.ones(len(keys), bool)
        single[1:] = ~twin
        heads = np.flatnonzero(single)
        head = order[heads]  # one occurrence of each string, in order
        any_met = np.logical_or.reduceat(met[order], heads)

        found, first = self.family.scan(ordered if len(heads) == len(ordered) else ordered[heads])
        out += first
        spread = np.zeros(len(keys), bool)
        spread[order] = np.repeat(found, np.diff(np.append(heads, len(order))))
        met |= spread
        fresh = np.flatnonzero(~found)
        if len(fresh):
            at = head[fresh]
            kept, seg = np.unique(own[at], return_inverse=True)  # segments without a new string are not held
            held = np.repeat(np.isin(np.arange(len(row)), kept), n + w - 1)
            new = np.concatenate([[0], np.cumsum(n[kept] + w - 1)[:-1]])
            r = row[kept]
            self.family.add(Level(w, text[held], new, t1[r], t2[r], start[r], new[seg] + step[at], any_met[fresh]))

        alone = np.flatnonzero(met & (times[own] == 1))
        if len(alone):
            cut = np.flatnonzero((np.diff(alone) != 1) | (np.diff(own[alone]) != 0)) + 1
            lo, hi = alone[np.concatenate([[0], cut])], alone[np.concatenate([cut - 1, [len(alone) - 1]])]
            r = row[own[lo]]
            out.append((t1[r], t2[r], start[r] + step[lo], start[r] + step[hi] + w))
        return tuple(np.concatenate(c) for c in zip(*out))


def _batches(source, width: int):
    """Segments in batches of about ``BATCH_WINDOWS`` windows, and rows without one as they are."""
    held, n = [], 0
    for batch in source:
        done = pc.is_null(batch.column("seg"))
        told = batch.filter(done)
        if told.num_rows:
            yield told, True
        batch = batch.filter(pc.invert(done))
        if not batch.num_rows:
            continue
        windows = np.cumsum(batch.column("size").to_numpy() - width + 1)
        at = 0
        while at < batch.num_rows:
            before = windows[at - 1] if at else 0
            to = min(int(np.searchsorted(windows, before + BATCH_WINDOWS - n)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            n += int(windows[to - 1] - before)
            at = to
            if n >= BATCH_WINDOWS:
                yield pa.concat_batches(held), False
                held, n = [], 0
    if held:
        yield pa.concat_batches(held), False


def index_scan(source, width: int, task: Task | None = None):
    """Spans of Arrow batches of segments, all through one index family."""
    task = task or Task(width)
    for batch, settled in _batches(source, width):
        if settled:
            lo = batch.column("start").to_numpy()
            yield emit(_SPANS, t1=batch.column("t1"), t2=batch.column("t2"), lo=lo, hi=lo + batch.column("size").to_numpy())
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2", "start", "met")]
        t1, t2, lo, hi = task.batch(*cols, batch.column("seg").to_pylist())
        if len(lo):
            yield emit(_SPANS, t1=t1, t2=t2, lo=lo, hi=hi)


def _spans(segments: DataFrame, width: int) -> DataFrame:
    return segments.mapInArrow(lambda source: index_scan(source, width), "t1 long, t2 long, lo long, hi long")


def segments(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Texts (by their two hashes) that go whole, and the segments that may hold repeated strings, dealt out by key."""
    first = _first(docs, width).groupBy("t1", "t2").agg(
        F.count("*").alias("times"), F.min("doc_id").alias("rep"), F.any_value("n_bytes").alias("n_bytes"), F.any_value("anchors").alias("anchors")
    )
    first = materialise(first, "anchors")
    places = first.select("t1", "t2", "rep", F.explode("anchors").alias("h"))
    alive = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("warm"))
    live = places.distinct().join(alive, "h").groupBy("t1", "t2", "rep").agg(F.collect_list(F.struct("h", "warm")).alias("x"))
    live = materialise(live.select("t1", "t2", "rep", F.col("x.h").alias("live"), F.col("x.warm").alias("hot")), "live")
    whole = first.where((F.col("times") > 1) & (F.col("n_bytes") >= width)).select("t1", "t2")

    d = _keyed(docs)
    same = (d["t1"] == live["t1"]) & (d["t2"] == live["t2"]) & d["doc_id"].eqNullSafe(live["rep"])
    found = d.join(live, same).select(d["text"], d["t1"], d["t2"], "live", "hot")
    anchors = live.agg(F.sum(F.size("live"))).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), anchors * 2 * width // INDEX_BYTES)
    return whole, _segments(found, width).repartition(parts, "key")


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``t1, t2, whole, spans`` of the texts (by their two hashes) that lose bytes."""
    whole, dealt = segments(docs, width)
    spans = _spans(dealt, width).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = spans.join(whole.withColumn("whole", F.lit(True)), ["t1", "t2"], "full")
    return materialise(out.select("t1", "t2", F.coalesce("whole", F.lit(False)).alias("whole"), "spans"), "spans")


def union_of(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the half-open spans; touching spans are one."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    cut = np.flatnonzero(lo[1:] > top[:-1]) + 1
    return list(zip(lo[np.concatenate([[0], cut])].tolist(), top[np.concatenate([cut - 1, [len(lo) - 1]])].tolist()))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    both = _keyed(docs).join(repeats(docs, width), ["t1", "t2"], "left").select("doc_id", "text", "whole", "spans")

    def run(batches):
        for batch in sliced(batches):
            whole, spans = batch.column("whole").to_pylist(), batch.column("spans")
            n, lost, runs, sha = [], [], [], []
            for i, text in enumerate(texts(batch)):
                if whole[i]:
                    gone = [(0, len(text))]
                elif whole[i] is None:
                    gone = []
                else:
                    v = spans[i].values
                    gone = union_of(v.field("lo").to_numpy(), v.field("hi").to_numpy())
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                n.append(len(text)), lost.append(sum(b - a for a, b in gone)), runs.append(len(gone)), sha.append(digest.hexdigest())
            yield emit(_RESULT, doc_id=batch.column(0), n_bytes=n, n_removed=lost, n_spans=runs, kept_sha256=sha)

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
