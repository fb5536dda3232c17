"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key ``-ln(u) / weight``, with ``u`` a hash of its ``doc_id``, so
reruns agree, and ``weight`` its quality. A source's target of words is met by complete epochs first;
for what is left, its documents are taken in order of their keys until the prefix sum of their sizes
meets the budget, the document at the edge giving only its first words.

The prefix sum is by digits: a key's place in the order is a number of 50 bits, and sizes are summed
map-side by its first 10 bits. The one cell per source that holds the edge is looked into by the next 10 bits,
and so on, until it has at most ``EDGE_ROWS`` rows, which are sorted. A source with most of the rows is
therefore never gathered in one task, and neither is a cell. Targets are found in one row per source, and
no text and no row is joined to another table but that of sources.

Defined cases: a null text has size 0, and the mix takes none of its words; a null source is a source,
ordered last; a null ``doc_id`` draws its key from the text; equal keys are ordered by ``doc_id``, then
by size and text, and are sorted together; repeated rows are taken each by itself, and rows are never told
apart by ``doc_id`` alone; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ._common import materialise, sliced, texts

WEIGHTS = (1, 2, 3)
CAP = 3
DIGIT, DIGITS = 10, 5
EDGE_ROWS = 1 << 16


def quality(ws: list[bytes]) -> float:
    """Weight of a document: its different words against the number that a text of its length has, 0.1 to 1.

    That number grows about as ``7 * sqrt(n)`` and is ``n`` at most; texts at or above it weigh 1.
    """
    n = len(ws)
    if not n:
        return 0.1
    return min(1.0, max(0.1, len(set(ws)) / min(n, 7 * n**0.5)))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``__key`` and its place ``__place`` to rows with ``__id, __text, __weight`` (``__text`` a hash)."""
    drawn = F.when(F.col("__id").isNull(), F.xxhash64(F.lit("mix"), "__text")).otherwise(F.xxhash64(F.lit("mix"), "__id"))
    u = (F.shiftrightunsigned(drawn, 11).cast("double") + 1) / F.lit(float(1 << 53) + 1)
    rows = rows.withColumn("__key", -F.log(u) / F.col("__weight"))
    top = (1 << DIGIT * DIGITS) - 1
    return rows.withColumn("__place", F.least(F.floor(F.lit(float(top)) * (1 - F.exp(-F.col("__key")))), F.lit(top)).cast("long"))


_SIZE = [("__size", pa.int64()), ("__weight", pa.float64())]


def measured(docs: DataFrame, payload: list[str]) -> DataFrame:
    """``payload`` columns of every row with ``__id, __source, __text, __size, __weight, __key, __place``."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__text")
    src = docs.select(*payload, F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), text_hash, F.col("text").alias("__read"))
    keep = [f for f in src.schema if f.name != "__read"]

    def run(batches):
        for batch in sliced(batches):
            all_words = [x.split() for x in texts(batch, "__read")]
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            more = [pa.array(list(map(f, all_words)), t) for f, (_, t) in zip((len, quality), _SIZE)]
            yield pa.RecordBatch.from_arrays(cols + more, names=[f.name for f in keep] + [n for n, _ in _SIZE])

    return keyed(src.mapInArrow(run, StructType([*keep, StructField("__size", LongType()), StructField("__weight", DoubleType())])))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat over the sources in order of their names. Water-filling: with sources ordered by
    ``cap * size / weight``, the filled ones are a prefix, and the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    r = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    r = r.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    r = r.withColumn("room", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("room") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    r = r.withColumn("total", F.sum("source_size").over(every).cast("double"))
    r = r.withColumn("filled", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    r = r.withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    r = r.withColumn("level", (F.col("total") - F.col("filled")) / F.col("rest_w"))
    # the first source, in this order, that the level doesn't fill sets the level for it and all later ones
    open_ = F.col("level") * F.col("w") < F.col("room")
    r = r.withColumn("level", F.first(F.when(open_, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.select("source", "source_size", F.coalesce(F.least("room", F.col("level") * F.col("w")), "room").alias("target"))


def _of_source(df: DataFrame, plan: DataFrame) -> DataFrame:
    return df.join(plan, df["__source"].eqNullSafe(plan["name"])).drop("name")


def planned(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """One row per source: ``name, source_size, target, epochs, rest``, and the cell ``edge`` (null: none) of ``shift`` low bits
    in which the fraction ends, with the words ``before`` it."""
    plan = targets(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")), weights, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "name")
    plan = materialise(plan.selectExpr("*", "0L AS edge", "0L AS before", f"{DIGIT * DIGITS} AS shift", "true AS open"), "plan")
    for k in range(DIGITS):
        low = DIGIT * (DIGITS - 1 - k)
        cell = F.shiftright("__place", low)
        edges = plan.where("open").select("name", "edge", "before", "rest", "shift")
        inside = _of_source(rows.select("__source", "__place", "__size"), edges).where(F.shiftright("__place", low + DIGIT) == F.col("edge"))
        sums = inside.groupBy("__source", cell.alias("cell")).agg(F.sum("__size").alias("n"), F.count("*").alias("m"), F.first("before").alias("start"), F.first("rest").alias("left"))
        order = Window.partitionBy("__source").orderBy("cell")  # at most 1024 cells per source
        sums = sums.withColumn("upto", F.col("start") + F.sum("n").over(order) - F.col("n")).where("upto <= left and left < upto + n")
        found = sums.select(F.col("__source").alias("same"), F.col("cell"), F.col("upto"), F.col("m"))
        plan = plan.join(found, F.col("name").eqNullSafe(F.col("same")) & F.col("open"), "left")
        hit = F.col("m").isNotNull()
        plan = plan.select(
            "name", "source_size", "target", "epochs", "rest", F.when(F.col("open"), F.col("cell")).otherwise(F.col("edge")).alias("edge"),
            F.when(hit, F.col("upto")).otherwise(F.col("before")).alias("before"), F.when(hit, low).otherwise(F.col("shift")).alias("shift"),
            F.coalesce(F.col("m") > edge_rows, F.lit(False)).alias("open"),
        )
        plan = materialise(plan, "plan")
        if plan.where("open").isEmpty():
            break
    return plan.drop("open")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (from ``measured``) with ``source_size, target, taken``; only rows of the edge's cell are sorted."""
    every = _of_source(rows, plan).withColumn("__cell", F.expr("shiftright(__place, shift)"))
    whole = F.when(F.col("edge").isNull(), F.col("rest") > 0).otherwise(F.col("__cell") < F.col("edge"))
    taken = F.col("epochs") * F.col("__size") + F.when(whole, F.col("__size")).otherwise(0)
    out = [*rows.columns, "source_size", "target", "taken"]
    plain = every.where("edge is null or __cell <> edge").withColumn("taken", taken).select(out)
    inside = Window.partitionBy("__source").orderBy("__key", "__id", "__size", "__text").rowsBetween(Window.unboundedPreceding, 0)
    last = every.where("__cell = edge").withColumn("upto", F.col("before") + F.sum("__size").over(inside))
    part = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("rest") - (F.col("upto") - F.col("__size"))))
    return plain.unionByName(last.withColumn("taken", F.col("epochs") * F.col("__size") + part).select(out))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row; ``taken`` counts words, repeats included."""
    rows = materialise(measured(docs, []), "sized")
    return _taken(rows, planned(rows, weights, cap, edge_rows)).select(
        F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "taken"
    )


def sample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The mix itself: each row once per complete epoch, and once more if the fraction selects it.

    A document at a budget's edge comes with its first words only (``n_chars`` counted anew, if there);
    documents without words are left out. The columns are those of ``docs``. Texts are read twice, once for the
    sums and once with all columns; no text moves but those of the edge's cells.
    """
    plan = planned(materialise(measured(docs, []), "sized"), weights, cap, edge_rows)
    fields = docs.schema
    own = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("__row")
    rows = _taken(measured(docs.select("doc_id", "source", "text", own), ["__row"]), plan).where("taken > 0")
    rows = rows.select(*[F.col(f"__row.`{f.name}`").alias(f.name) for f in fields], F.col("__size"), F.col("taken").alias("__taken"))

    def run(batches):
        for batch in sliced(batches):
            size, taken = batch.column("__size").to_pylist(), batch.column("__taken").to_pylist()
            full = [t // s for s, t in zip(size, taken)]
            edge = [t % s for s, t in zip(size, taken)]
            names = [f.name for f in fields]
            data = pa.RecordBatch.from_arrays(batch.select(names).columns, names=names)
            whole = data.take(pa.array([i for i, k in enumerate(full) for _ in range(k)], pa.int64()))
            if whole.num_rows:
                yield from sliced(iter([whole]))
            cut = [i for i, k in enumerate(edge) if k]
            if cut:
                part = data.take(pa.array(cut, pa.int64()))
                short = [head(x, edge[i]).decode() for i, x in zip(cut, texts(part))]
                cols = []
                for f in fields:
                    col = part.column(part.schema.get_field_index(f.name))
                    col = pa.array(short, col.type) if f.name == "text" else pa.array(map(len, short), col.type) if f.name == "n_chars" else col
                    cols.append(col)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, fields)


def head(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    rest = text.split(None, n)
    return text[: len(text) - len(rest[n])].rstrip() if len(rest) > n else text
