"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A document's ids and a closing separator make its pieces; only documents above the capacity are cut, the
first piece taking the shorter rest, so full pieces fill sequences of their own. The other pieces are
dealt by a hash into *regions* of about ``REGION`` pieces, whose number grows with the corpus, so no task
ever holds more than a bounded set. A region that best-fit packs into as few bins as its sizes allow is
done; no search can do better, and ``region_bins`` and ``region_bound`` of each row tell so. For every
other region, ``ISLANDS`` islands search: each is a row of a table and a task's work of its own, and evolves
a population of packings. Crossover injects whole well-filled bins of one parent into another, drops the
bins that hold the same pieces, and best-fits the displaced ones in order of size. After each epoch the
populations are written, and each island's best packing migrates to the next island's in a join. The bins
of all regions with much room are then opened and packed together once more, in as many regions as those need.

Ids come from the named vocabulary file of the ``tokenizers`` library. Texts without special-token
strings are encoded by ``tiktoken`` over that file's own vocabulary, which gives the same ids in a
fraction of the time; a text with such a string goes through ``tokenizers`` itself.

Defined cases: a null or empty text is one piece, the separator alone; repeated rows are packed each by
itself; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import json
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import emit, materialise, sliced, texts

CAPACITY = 2048
SEPARATOR = 0
REGION = 4096
#: Islands of a region, packings of an island, epochs, and children of an island in each epoch.
ISLANDS, MEMBERS, EPOCHS, CHILDREN = 4, 4, 4, 8

#: Bins with a lesser share filled are opened and packed together once more.
LOOSE = 0.95

#: The split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as U+0100 onwards, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        names, of = {t["content"] for t in spec["added_tokens"]}, _byte_of_char()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in names}
        self.fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: bytes) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text.decode(), disallowed_special=()), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECE = pa.schema([(x, pa.int64()) for x in ("doc_id", "piece", "start", "length", "ids_crc32")])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in sliced(batches):
            owner, rows = batch.column(0).to_pylist(), []
            for own, text in zip(owner, texts(batch)):
                ids = np.append(enc.ids(text) if text else np.zeros(0, np.uint32), np.uint32(SEPARATOR)).astype("<u4")
                n = len(ids)
                at, to, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    rows.append((own, k, at, to - at, zlib.crc32(ids[at:to])))
                    at, to, k = to, to + capacity, k + 1
            cols = list(zip(*rows))
            yield emit(_PIECE, **dict(zip(_PIECE.names, cols)))

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- one region
Packing = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Packing, loads: list[int], capacity: int) -> None:
    """Puts each item into the fullest bin with room, else a new one; rooms are the bits of one integer."""
    at: dict[int, list[int]] = {}
    free = 0
    for b, load in enumerate(loads):
        room = capacity - load
        if room:
            at.setdefault(room, []).append(b)
            free |= 1 << room
    for i in items:
        size = sizes[i]
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = at[room]
            b = stack.pop()
            if not stack:
                free ^= 1 << room
                del at[room]
            bins[b].append(i)
            loads[b] += size
        else:
            b, room = len(bins), capacity
            bins.append([i])
            loads.append(size)
        room -= size
        if room:
            at.setdefault(room, []).append(b)
            free |= 1 << room


def _fitness(loads: list[int], capacity: int) -> tuple[int, float]:
    return (-len(loads), sum(x * x for x in loads) / (capacity * capacity))


def _loads(sizes: list[int], bins: Packing) -> list[int]:
    return [sum(map(sizes.__getitem__, b)) for b in bins]


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> tuple[Packing, list[int]]:
    """A child of ``a`` with well-filled bins of ``b``."""
    loads = _loads(sizes, b)
    filled = [k for k, x in enumerate(loads) if x >= 0.99 * capacity] or list(range(len(b)))
    chosen = rng.sample(filled, max(1, int(len(filled) * rng.uniform(0.2, 0.6))))
    injected = [list(b[k]) for k in chosen]
    taken = {i for x in injected for i in x}
    kept: Packing = []
    displaced: list[int] = []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    # the emptiest bins are opened as well, so that their pieces may find better places
    own = _loads(sizes, kept)
    order = sorted(range(len(kept)), key=own.__getitem__)
    opened = {k for k in order[: max(1, len(kept) // 20)] if own[k] < 0.97 * capacity}
    displaced += [i for k in opened for i in kept[k]]
    bins = injected + [x for k, x in enumerate(kept) if k not in opened]
    load = _loads(sizes, bins)
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(sizes, displaced, bins, load, capacity)
    return bins, load


Member = tuple[tuple[int, float], Packing]


def first_members(sizes: list[int], capacity: int, rng: random.Random, members: int = MEMBERS) -> list[Member]:
    """Best-fit packings in orders of size with more and more noise, the best first."""
    out = []
    for m in range(members):
        noise = 0.02 * (1 + m)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))
        bins: Packing = []
        loads: list[int] = []
        best_fit(sizes, order, bins, loads, capacity)
        out.append((_fitness(loads, capacity), bins))
    return sorted(out, key=lambda x: x[0], reverse=True)


def epoch(island: list[Member], sizes: list[int], capacity: int, rng: random.Random, children: int = CHILDREN) -> list[Member]:
    """The island after so many crossovers, each child taking the place of the worst if it is better."""
    bound = -(-sum(sizes) // capacity)
    island = sorted(island, key=lambda x: x[0], reverse=True)
    for _ in range(children):
        if -island[0][0][0] <= bound:
            break
        a, b = rng.sample(island, 2)
        bins, loads = cross(a[1], b[1], sizes, capacity, rng)
        child = (_fitness(loads, capacity), bins)
        if child[0] > island[-1][0]:
            island[-1] = child
            island.sort(key=lambda x: x[0], reverse=True)
    return island


def _assigned(bins: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            out[i] = b
    return out


def _bins(assigned: list[int]) -> Packing:
    out: Packing = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, b in enumerate(assigned):
        out[b].append(i)
    return out


_INTS = pa.list_(pa.int32())
_REGION = pa.schema([("region", pa.int64()), ("uids", pa.list_(pa.int64())), ("sizes", _INTS), ("bound", pa.int64()), ("bins", pa.int64()), ("packing", _INTS)])
_ISLAND = pa.schema([("region", pa.int64()), ("island", pa.int32()), ("sizes", _INTS), ("bins", pa.int64()), ("members", pa.list_(_INTS))])
_PLACED = pa.schema([("uid", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int32()), ("region_bins", pa.int64()), ("region_bound", pa.int64())])


def _plain(regions: DataFrame, capacity: int) -> DataFrame:
    """Best-fit of each region in order of size, and the fewest bins that its sizes allow."""

    def run(batches):
        for batch in batches:
            for region, uids, sizes in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                bins: Packing = []
                best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), bins, [], capacity)
                bound = -(-sum(sizes) // capacity)
                yield emit(_REGION, region=[region], uids=[uids], sizes=[sizes], bound=[bound], bins=[len(bins)], packing=[_assigned(bins, len(sizes))])

    return regions.mapInArrow(run, "region long, uids array<long>, sizes array<int>, bound long, bins long, packing array<int>")


def _island_epoch(islands: DataFrame, capacity: int, number: int) -> DataFrame:
    """Each island's next population, from ``region, island, sizes, bins, members, elite, met``; before the first epoch there are no members.

    Where some island of the region has met the bound, nothing is left to search for.
    """

    def run(batches):
        for batch in batches:
            for region, island, sizes, bins, members, elite, met in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if not met:
                    rng = random.Random((region * ISLANDS + island) * EPOCHS + number)
                    if members is None:
                        now = first_members(sizes, capacity, rng)
                    else:  # the elite of the island before takes the place of the worst
                        packings = [_bins(x) for x in [*members[:-1], elite]]
                        now = [(_fitness(_loads(sizes, x), capacity), x) for x in packings]
                    now = epoch(now, sizes, capacity, rng)
                    bins, members = len(now[0][1]), [_assigned(x, len(sizes)) for _, x in now]
                yield emit(_ISLAND, region=[region], island=[island], sizes=[sizes], bins=[bins], members=[members])

    return islands.mapInArrow(run, "region long, island int, sizes array<int>, bins long, members array<array<int>>")


def evolved(regions: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``region, bins, packing``: the best that the islands of each region (``region, sizes, bound``) find."""
    tasks = max(1, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = regions.select("region", "bound")
    state = regions.select("region", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes")
    state = state.selectExpr("region", "island", "sizes", "0L AS bins", "CAST(NULL AS array<array<int>>) AS members", "CAST(NULL AS array<int>) AS elite", "false AS met")
    for k in range(EPOCHS):
        state = materialise(_island_epoch(state.repartition(tasks, "region", "island"), capacity, k), "islands")
        if k < EPOCHS - 1:
            elites = state.select("region", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("members")[0].alias("elite"))
            met = state.groupBy("region").agg(F.min("bins").alias("least")).join(bounds, "region").select("region", (F.col("least") <= F.col("bound")).alias("met"))
            state = state.join(elites, ["region", "island"]).join(met, "region").select("region", "island", "sizes", "bins", "members", "elite", "met")
    best = F.min_by(F.struct("bins", F.col("members")[0].alias("packing")), F.struct("bins", "island")).alias("x")
    return state.groupBy("region").agg(best).select("region", "x.bins", "x.packing")


def _placed(regions: DataFrame, capacity: int, tag: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for region, uids, sizes, bound, bins, packing in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                load, offset = [0] * bins, []
                for size, b in zip(sizes, packing):
                    offset.append(load[b])
                    load[b] += size
                yield emit(
                    _PLACED, uid=uids, sequence_id=[((region << 20) + b) * 4 + tag for b in packing], offset=offset, fill=[load[b] for b in packing],
                    region_bins=[bins] * len(uids), region_bound=[bound] * len(uids),
                )

    return regions.mapInArrow(run, "uid long, sequence_id long, offset long, fill int, region_bins long, region_bound long")


def pack_regions(sized: DataFrame, capacity: int = CAPACITY, size: int = REGION, tag: int = 1) -> DataFrame:
    """``uid, sequence_id, offset, fill, region_bins, region_bound`` of pieces ``uid, length`` shorter than the capacity."""
    n = max(1, -(-sized.count() // size))
    dealt = sized.select(F.pmod(F.xxhash64("uid", F.lit(tag)), F.lit(n)).alias("region"), F.struct("uid", F.col("length").cast("int").alias("length")).alias("x"))
    regions = dealt.groupBy("region").agg(F.sort_array(F.collect_list("x")).alias("x"))  # a hash deals out about ``size`` pieces each
    first = materialise(_plain(regions.select("region", "x.uid", "x.length"), capacity), "regions")
    open_ = first.where("bins > bound").select("region", "sizes", "bound")
    if open_.isEmpty():
        return _placed(first.select("region", "uids", "sizes", "bound", "bins", "packing"), capacity, tag)
    better = evolved(open_, capacity).select("region", F.col("bins").alias("b"), F.col("packing").alias("p"))
    both = first.join(better, "region", "left")
    win = F.col("b") < F.col("bins")
    return _placed(
        both.select(
            "region", "uids", "sizes", "bound", F.when(win, F.col("b")).otherwise(F.col("bins")).alias("bins"), F.when(win, F.col("p")).otherwise(F.col("packing")).alias("packing")
        ),
        capacity, tag,
    )


OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "region_bins", "region_bound"]


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, and its region's bins and bound (null for full pieces).

    The vocabulary file is read on the driver and by every executor, under the same path.
    """
    rows = pieces(docs, vocabulary or default_vocabulary(), capacity).withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows, "pieces")
    none = F.lit(None).cast("long")
    full = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid") * 4).withColumn("offset", F.lit(0).cast("long"))
    full = full.withColumn("region_bins", none).withColumn("region_bound", none)
    sized = rows.where(F.col("length") < capacity).select("uid", "length")

    first = materialise(pack_regions(sized, capacity, region, 1), "packed")
    loose = materialise(first.where(F.col("fill") < LOOSE * capacity).select("uid").join(sized, "uid"), "loose")
    second = pack_regions(loose, capacity, region, 2)
    where = first.where(F.col("fill") >= LOOSE * capacity).unionByName(second)
    return full.select(OUT).unionByName(rows.join(where, "uid").select(OUT))
