"""SimHash near-duplicates: exact comparison of distinct fingerprints in tiles.

Only distinct fingerprints are compared, so exact copies cost nothing here. Two fingerprints within
``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks; a *bucket* holds the
fingerprints that agree on one such choice, so no link is lost and no bucket needs another one. In a
bucket, fingerprints are ordered by their population counts and cut into tiles; pairs of tiles whose
counts differ beyond the radius are skipped and the others are compared whole, by numpy's exclusive-or
and bit count. A bucket beyond ``bucket_rows`` is dealt out as pairs of tiles of one population count.
Each task returns a spanning forest of what it has linked, never all pairs.

Defined cases: null and blank texts have fingerprint zero and link like any other; repeated rows are
rows of their own in one component; a null ``doc_id`` is never a component's smallest unless it is the
only one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Windows, emit, materialise, mix, signed, sliced, text_hash, texts, word_hashes
from ._components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
BLOCKS = 4
TILE = 1024
BUCKET_ROWS = 8192
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, A-Z lower-cased, repeats included."""
    ws = text.lower().split()
    if not ws:
        return 0
    whole = b" ".join(ws)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            fps = np.array([fingerprint(x, shingle) for x in texts(batch)], np.uint64)
            yield emit(_FP, doc_id=batch.column(0), fp=signed(fps))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of two small tiles within the radius."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hooks the roots of linked members, all at once, until every link is inside one tree."""
        while len(i):
            r = self.roots()
            a, b = r[i], r[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def forest(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest ``(member, root)`` of the links among fingerprints, by tiles in order of population count.

    With ``split``, only links between the first ``split`` fingerprints and the rest are looked for.
    """
    own = np.zeros(len(fps), bool) if split is None else np.arange(len(fps)) >= split
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    x, side, pops = fps[order], own[order], np.bitwise_count(fps[order]).astype(int)
    trees = _Forest(len(x))
    for at in range(0, len(x), tile):
        top = min(at + tile, len(x))
        for to in range(at, len(x), tile):
            if pops[to] - pops[top - 1] > radius:
                break
            i, j = linked(x[at:top], x[to : to + tile], radius)
            i, j = i + at, j + to
            take = i < j if split is None else (i < j) & (side[i] != side[j])
            trees.join(i[take], j[take])
    roots = trees.roots()
    member = roots != np.arange(len(x))
    return x[member], x[roots[member]]


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(parts[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _runs(batches, keys: list[str]):
    """Columns of each run of equal keys in sorted batches; a run may go on over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if not len(change):
            continue
        yield table.slice(0, change[-1]), np.concatenate([[0], change])
        held = table.slice(change[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        yield table, np.concatenate([[0], change, [table.num_rows]])


def _edges(batches, keys: list[str], radius: int):
    for table, cuts in _runs(batches, keys):
        fps = table["fp"].to_numpy().view(np.uint64)
        second = table["side"].to_numpy() if "side" in table.column_names else None
        size = np.diff(cuts)
        us, vs = [], []
        if second is None:
            two = cuts[:-1][size == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            us.append(fps[near]), vs.append(fps[near + 1])
        for a, n in zip(cuts[:-1][size > (2 if second is None else 1)], size[size > (2 if second is None else 1)]):
            part = fps[a : a + n]
            if second is None:
                u, v = forest(part, radius)
            else:
                late = second[a : a + n] == 1
                first, rest = part[~late], part[late]
                u, v = forest(np.concatenate([first, rest]), radius, split=len(first) if len(first) and len(rest) else None)
            us.append(u), vs.append(v)
        if us and sum(map(len, us)):
            yield emit(_EDGE, u=signed(np.concatenate(us)), v=signed(np.concatenate(vs)))


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``u, v`` that connect all fingerprints (column ``fp``, distinct) within the radius of each other."""
    masks = _masks(blocks, radius)
    to_long = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(to_long)])
    rows = distinct.select("fp", F.explode(keys).alias("b")).select("fp", "b.k", "b.key")
    sizes = rows.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = materialise(rows.join(sizes, ["k", "key"]), "buckets")

    small = held.where(F.col("n") <= bucket_rows).select("k", "key", "fp")
    parts = max(1, int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = small.repartition(parts, "k", "key").sortWithinPartitions("k", "key")
    out = small.mapInArrow(lambda it: _edges(it, ["k", "key"], radius), "u long, v long")

    # Larger buckets: tiles of one population count, each part met with every part within the radius.
    pop = F.bit_count("fp").cast("int")
    big = held.where(F.col("n") > bucket_rows).withColumn("pop", pop)
    cells = big.groupBy("k", "key", "pop").agg(F.ceil(F.count("*") / F.lit(bucket_rows // 2)).cast("int").alias("parts"))
    near = F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius)).alias("other")
    ours = cells.select("k", "key", "pop", F.col("parts").alias("own_parts"), near)
    theirs = cells.select("k", "key", F.col("pop").alias("other"), F.col("parts").alias("other_parts"))
    plan = ours.join(theirs, ["k", "key", "other"])
    big = big.join(plan, ["k", "key", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("own_parts")).cast("int"))
    big = big.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    mine, yours = F.struct(F.col("pop").alias("p"), F.col("part").alias("q")), F.struct(F.col("other").alias("p"), F.col("other_part").alias("q"))
    big = big.select("k", "key", F.least(mine, yours).alias("lo"), F.greatest(mine, yours).alias("hi"), (mine > yours).cast("int").alias("side"), "fp")
    big = big.select("k", "key", F.col("lo.p").alias("p1"), F.col("lo.q").alias("q1"), F.col("hi.p").alias("p2"), F.col("hi.q").alias("q2"), "side", "fp")
    tile = ["k", "key", "p1", "q1", "p2", "q2"]
    big = big.repartition(parts, *tile).sortWithinPartitions(*tile)
    return out.unionByName(big.mapInArrow(lambda it: _edges(it, tile, radius), "u long, v long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``; the component is the smallest ``doc_id`` reachable."""
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialise(components(links(distinct.select("fp"), radius)), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialise(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "named")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- documents at a similarity
WORDS, SIMILARITY = 5, 0.8
#: Standard errors added to the radius, so that fingerprints lose no pair at the similarity, and what ties add in small sets.
MARGIN, TIES = 4.5, 0.1
BITS, BANDS, ROWS = 1024, 16, 4
GROUP_ROWS = 32768
#: Shingles of one task's group of sets; larger groups are dealt out as pairs of parts.
GROUP_SHINGLES = 4 << 20

_SEEDS = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, BITS // 64 + BANDS * ROWS, np.uint64)
_WIDE = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("fp", pa.binary())])
_WIDE_DDL = "doc_id long, t long, node long, n int, bands array<long>, fp binary"


def shingle_set(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """Hashes of the different word shingles, A-Z lower-cased; of fewer words, the whole sequence."""
    w = word_hashes(text.lower().split())
    return np.unique(Windows(w).of(min(shingle, max(len(w), 1))))


def set_node(s: np.ndarray) -> int:
    """Identity of a shingle set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def wide_sketch(s: np.ndarray) -> tuple[int, list[int], bytes]:
    """Identity of a shingle set, its min-hash bands and its SimHash of ``BITS`` bits."""
    if not len(s):
        return 0, [], b"\0" * (BITS // 8)
    fp = []
    for seed in _SEEDS[: BITS // 64]:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(s), 1 << 14):
            h = mix(s[at : at + (1 << 14)] ^ seed)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        fp.append(np.packbits(2 * ones > len(s), bitorder="little").tobytes())
    least = np.array([mix(s ^ seed).min() for seed in _SEEDS[BITS // 64 :]], np.uint64).reshape(BANDS, ROWS)
    bands = [xxhash.xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]
    return set_node(s), bands, b"".join(fp)


def radius_of(a: np.ndarray, b: int, similarity: float) -> np.ndarray:
    """Most differing bits of two sets of ``a`` and ``b`` shingles at this Jaccard similarity; -1 where their sizes rule it out."""
    cosine = similarity / (1 + similarity) * (a + b) / np.sqrt(a * float(b))
    share = np.arccos(np.minimum(cosine, 1)) / np.pi + TIES / np.sqrt(np.minimum(a, b))
    return np.where(cosine > 1, -1, BITS * share + MARGIN * np.sqrt(BITS * share * (1 - share)))


def overlaps(sets: list[np.ndarray], similarity: float, limit: int = 1 << 20) -> Callable[[int, np.ndarray], np.ndarray]:
    """Tells which of the sets ``near`` have at least this Jaccard similarity with set ``p``, by counting what they share."""
    least = Fraction(str(similarity))
    n = np.array([len(s) for s in sets], np.int64)

    def check(p: int, near: np.ndarray) -> np.ndarray:
        mine, ends = sets[p], np.cumsum(n[near])
        shared, at = np.zeros(len(near), np.int64), 0
        while at < len(near):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            theirs = np.concatenate([sets[k] for k in near[at:to]])
            found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            shared[at:to] = np.add.reduceat(found, ends[at:to] - n[near[at:to]] - (ends[at - 1] if at else 0), dtype=np.int64)
            at = to
        return least.denominator * shared >= least.numerator * (n[near] + n[p] - shared)

    return check


def wide_forest(
    fps: np.ndarray, n: np.ndarray, similarity: float, late: np.ndarray | None = None, check: Callable[[int, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest ``(member, root)`` of the links in one tile, fingerprints as rows of 64-bit numbers.

    Each member in turn is compared with the whole tile; members of the largest tree come last, and as
    soon as only they are left the rest can't join anything new. With ``late``, only links between its
    two sides count; with ``check``, only those that it confirms.
    """
    m = len(fps)
    trees = _Forest(m)
    pops = np.bitwise_count(fps).sum(1, dtype=np.int64)
    todo = np.ones(m, bool)
    roots = trees.roots()
    every = np.arange(m)
    while todo.any():
        size = np.bincount(roots, minlength=m)
        open_ = np.flatnonzero(todo & (roots != size.argmax())) if size.max() > 1 else np.flatnonzero(todo)
        if not len(open_):
            break
        for p in open_[:1] if size.max() == 1 else open_[:64]:
            todo[p] = False
            radius = radius_of(n, n[p], similarity)
            near = np.flatnonzero(todo & (roots != roots[p]) & (np.abs(pops - pops[p]) <= radius))
            if late is not None:
                near = near[late[near] != late[p]]
            near = near[np.bitwise_count(fps[near] ^ fps[p]).sum(1, dtype=np.int64) <= radius[near]]
            if check is not None and len(near):
                near = near[check(p, near)]
            if len(near):
                trees.join(near, np.full(len(near), p))
                roots = trees.roots()
    member = np.flatnonzero(roots != every)
    return member, roots[member]


def _wide_edges(batches, keys: list[str], similarity: float):
    for table, cuts in _runs(batches, keys):
        node, n = table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64)
        fps = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint64).reshape(len(node), -1)
        side = table["side"].to_numpy() if "side" in table.column_names else None
        held = table["shingles"].combine_chunks() if "shingles" in table.column_names else None
        us, vs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            check = held and overlaps([np.frombuffer(x.as_buffer(), np.uint64) for x in held[a:b]], similarity)
            i, j = wide_forest(fps[a:b], n[a:b], similarity, None if side is None or not side[a:b].any() else side[a:b], check)
            us.append(node[a + i]), vs.append(node[a + j])
        if us:
            yield emit(_EDGE, u=np.concatenate(us), v=np.concatenate(vs))


_SET = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])


def _true_edges(src: DataFrame, least: DataFrame, blocks: DataFrame, shingle: int, similarity: float, group_shingles: int) -> DataFrame:
    """Edges that connect all nodes of a block (column ``root``) whose shingle sets are this similar; one text of each node is read again."""

    def run(batches):
        for batch in sliced(batches):
            wanted = batch.column(2).to_pylist()
            sets = [shingle_set(x, shingle) for x in texts(batch)]
            nodes = [set_node(s) for s in sets]
            take = [k for k, (a, b) in enumerate(zip(nodes, wanted)) if b is None or a == b]
            yield emit(_SET, node=[nodes[k] for k in take], shingles=[sets[k].tobytes() for k in take])

    members = least.join(blocks, "node")
    known = src.join(members.select(F.col("least").alias("doc_id"), F.col("node").alias("wanted")), "doc_id").select("doc_id", "text", "wanted")
    nameless = src.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("long").alias("wanted"))
    sets = known.unionByName(nameless).mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])
    parts_of = F.greatest(F.lit(1), F.ceil(F.sum("n") * 2 / group_shingles)).cast("int")
    q = members.groupBy("root").agg(F.when(F.sum("n") > group_shingles, parts_of).otherwise(1).alias("q"))
    held = sets.join(members.join(q, "root").select("node", "n", "fp", "root", "q"), "node")
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    side = (F.col("part") > F.col("other")).cast("int").alias("side")
    held = held.select("root", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), side, "node", "n", "fp", "shingles")
    parts = max(1, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tile = ["root", "p1", "p2"]
    held = held.repartition(parts, *tile).sortWithinPartitions(*tile)
    return materialise(held.mapInArrow(lambda it: _wide_edges(it, tile, similarity), "u long, v long"), "true_edges")


def similar_documents(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``doc_id, component_id`` per row of ``docs``: components of documents whose shingle sets are this similar (see ``similar_rows``)."""
    return similar_rows(docs, shingle, similarity, group_rows, group_shingles).select("doc_id", F.col("chosen.doc_id").alias("component_id"))


def similar_rows(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``doc_id, t, chosen`` per row of ``docs``, ``t`` a hash of its text: components of documents whose shingle sets are this similar.

    ``chosen`` is the ``doc_id`` and ``t`` of a component's first row, null ids last, so rows with one id are told apart.
    At a similarity of 0.8, fingerprints differ in about 15 % of their bits, so 64 bits are too few to
    tell (the standard error is 4.5 %) and no choice of equal bit blocks finds such pairs: fingerprints
    here have 1024 bits, the radius follows from the two set sizes, and tiles are the groups that agree
    on one of 16 min-hash bands (a pair at 0.8 is missed with a chance of 0.0002). Fingerprints only
    propose: the radius takes in pairs somewhat below the similarity too. Every true link lies inside a
    component of what is proposed; there, documents are linked if their shingle sets themselves are
    this similar.
    """

    def run(batches):
        for batch in sliced(batches):
            node, n, bands, fp = [], [], [], []
            for text in texts(batch):
                s = shingle_set(text, shingle)
                k, b, f = wide_sketch(s)
                node.append(k), n.append(len(s)), bands.append(b), fp.append(f)
            yield emit(_WIDE, doc_id=batch.column(0), t=batch.column(2), node=node, n=n, bands=bands, fp=fp)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("t"))
    rows = materialise(src.mapInArrow(run, _WIDE_DDL), "sketches")
    one = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")
    least = rows.groupBy("node").agg(F.min(one).alias("one"), *[F.any_value(c).alias(c) for c in ("n", "bands", "fp")])
    least = materialise(least.withColumn("least", F.col("one.doc_id")), "sets")

    keyed = least.select("node", "n", "fp", F.posexplode("bands").alias("k", "key"))
    groups = keyed.groupBy("k", "key").agg(F.count("*").alias("m")).where("m > 1")
    held = materialise(keyed.join(groups, ["k", "key"]), "tiles")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = held.where(F.col("m") <= group_rows).select("k", "key", "node", "n", "fp")
    small = small.repartition(parts, "k", "key").sortWithinPartitions("k", "key")
    edges = small.mapInArrow(lambda it: _wide_edges(it, ["k", "key"], similarity), "u long, v long")
    big = held.where(F.col("m") > group_rows).withColumn("q", F.ceil(F.col("m") * 2 / group_rows).cast("int"))
    big = big.withColumn("part", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    big = big.select("k", "key", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "n", "fp")
    tile = ["k", "key", "p1", "p2"]
    big = big.repartition(parts, *tile).sortWithinPartitions(*tile)
    edges = edges.unionByName(big.mapInArrow(lambda it: _wide_edges(it, tile, similarity), "u long, v long"))

    blocks = materialise(components(edges), "blocks")
    edges = _true_edges(src, least, blocks, shingle, similarity, group_shingles)

    roots = components(edges)
    named = least.select("node", "one").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("one").alias("one"))
    known = named.select("node", "root").join(names, "root").select("node", F.struct("one.doc_id", "one.t").alias("chosen"))
    return rows.select("doc_id", "t", "node").join(known, "node").select("doc_id", "t", "chosen")


def keep_one(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar documents, with all columns: that with the smallest ``doc_id``, of several texts under it
    the one with the least hash, of repeated rows any. A null ``doc_id`` stays only where its group has no other."""
    chosen = materialise(similar_rows(docs, shingle, similarity).select(F.col("chosen.doc_id").alias("__id"), F.col("chosen.t").alias("__t")).distinct(), "kept")
    mine = docs.withColumn("__own", text_hash())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__t"))
    return mine.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__own"]).drop("__own")
