"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised, each row falls into a cell, and cells follow the Hilbert
curve, so that a run of the order is narrow in every dimension and a file can be skipped by any of
them. The order (curve index, hash of the id, id) is cut into runs whose row counts differ by one at
most. Ranks come from counts: a cell's offset from the counts of cells before it (at most
2**(bits * dimensions) of them), a slice's offset inside its cell, and the row's place in the slice; a
cell that holds a third of all rows is dealt over many slices.

Defined results: nulls of a dimension sort last; equal rows keep an order by all their columns; an
empty table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

BITS = 5


def hilbert(axes: list[str], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell with coordinates `axes` below 2**bits.

    Inverse undo and Gray steps run over one array of coordinates; then bits are interleaved."""
    n = len(axes)
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    start = F.array(*[F.col(a).cast("int") for a in axes])

    def bound(value: Column, body) -> Column:
        """`body` of `value`, which is computed once however often the body names it."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def undone() -> Column:
        if not steps:
            return start
        return F.aggregate(
            F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps]),
            start,
            lambda x, s: F.transform(
                x,
                lambda v, k: F.when(
                    (F.get(x, s["i"]).bitwiseAND(s["q"])) != 0,
                    F.when(k == 0, v.bitwiseXOR(s["q"] - 1)).otherwise(v),
                ).otherwise(
                    F.when(
                        (k == 0) | (k == s["i"]),
                        v.bitwiseXOR(F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(s["q"] - 1)),
                    ).otherwise(v)
                ),
            ),
        )

    def gray(u: Column) -> Column:
        return F.transform(u, lambda _, k: F.aggregate(F.slice(u, F.lit(1), k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def turn(g: Column) -> Column:
        return F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
            F.lit(0),
            lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )

    def interleaved(x: Column) -> Column:
        return F.aggregate(
            F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)]),
            F.lit(0).cast("long"),
            lambda h, s: h * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0),
        )

    return bound(undone(), lambda u: bound(gray(u), lambda g: bound(turn(g), lambda t: bound(
        F.transform(g, lambda v: v.bitwiseXOR(t)), interleaved))))


def _even(df: DataFrame, name: str, bits: int, as_name: str) -> DataFrame:
    """(value, code): values of a column in order, coded so that codes hold about equal row counts."""
    counts = df.groupBy(name).agg(F.count("*").alias("n"))
    order = W.orderBy(F.col(name).asc_nulls_last())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select(
        F.col(name).alias(as_name + "_value"),
        F.floor(before * (1 << bits) / F.sum("n").over(W.partitionBy())).cast("int").alias(as_name),
    )


def place(rows: DataFrame, shards: int, dims=("source", "lang"), size: str = "size", row_id: str = "doc_id") -> DataFrame:
    """`rows` with shard (0 to shards - 1) and slot (from 0, without gaps, in curve order)."""
    coded = rows
    axes = []
    for i, name in enumerate(dims):
        axis = f"hilbert_axis{i}"
        coded = coded.join(_even(rows, name, BITS, axis),
                           F.col(name).eqNullSafe(F.col(axis + "_value"))).drop(axis + "_value")
        axes.append(axis)
    last = f"hilbert_axis{len(dims)}"
    scale = F.floor((F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")) - 4) * 2)
    coded = coded.withColumn(last, F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), scale)).cast("int"))
    axes.append(last)
    coded = coded.withColumn("hilbert_slice", F.substring(F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("null"))), 1, 2))
    slices = cut(coded.groupBy(*axes, "hilbert_slice").agg(F.count("*").alias("held")))
    cells = slices.groupBy(*axes).agg(F.sum("held").alias("cell_held")).withColumn("curve", hilbert(axes))
    ahead = W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        *axes,
        F.coalesce(F.sum("cell_held").over(ahead), F.lit(0)).alias("cell_at"),
        F.sum("cell_held").over(W.partitionBy()).alias("rows_in_all"),
    )
    within = W.partitionBy(*axes).orderBy("hilbert_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        slices.withColumn("slice_at", F.coalesce(F.sum("held").over(within), F.lit(0)))
        .drop("held").join(cells, axes)
    )
    key = W.partitionBy(*axes, "hilbert_slice").orderBy(
        F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("null"))), *[F.col(c) for c in rows.columns]
    )
    n, at = F.col("rows_in_all"), F.col("curve_rank")
    return (
        coded.withColumn("in_slice", F.row_number().over(key) - 1)
        .join(starts, [*axes, "hilbert_slice"])
        .withColumn("curve_rank", F.col("cell_at") + F.col("slice_at") + F.col("in_slice"))
        .withColumn("shard", F.expr(f"curve_rank * {shards} div rows_in_all").cast("int"))
        .withColumn("slot", at - F.expr(f"(shard * rows_in_all + {shards - 1}) div {shards}"))
        .select(*rows.columns, "shard", F.col("slot").cast("long").alias("slot"))
    )


def sized(docs: DataFrame) -> DataFrame:
    """Metadata of every document: size is the text's UTF-8 bytes (null: none) plus 16."""
    return docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); the law is `rows`: counts are at most
    one apart, so another number of shards deals all anew and grown_shard is null."""
    return place(sized(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
