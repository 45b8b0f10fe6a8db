"""Near duplicates of embeddings by sorted projection passes.

Equal vectors of a label are one class. In each of `PASSES` passes a vector gets `BITS` random
projections' signs, read as one number; the vectors of a label are put in the order of these numbers and
cut into blocks of `BLOCK`. Vectors of one block or of neighbouring blocks are compared (the bounded
window); a tile of the window holds `WIDE` blocks and the one after them, so that a vector goes to 1 + 1 / WIDE
tiles a pass. A group that is denser than the label at large may be longer than the window: vectors that share the first
`PREFIX` bits, and one more for each doubling of the label beyond 2**PREFIX blocks, are compared all in tiles of two
blocks, so that at any size an evenly spread label gives each prefix about a block, and only dense groups give more.
At a cosine of 0.98 two vectors share 12 bits with probability 0.45 and 20 bits with 0.27, so that ten passes
find 0.997 and 0.95 of such pairs; nearer ones are found more surely. Cosines are in double precision.

A pair counts in the first pass that compares it, which both rows tell from their blocks and prefixes of
all passes, so counts are summed without a list of pairs; each tile reports the links of its vectors and
the smallest id each is joined to, and those are united across tiles and passes.

Positions come from counts per label and leading bits plus a running number inside, so that no label is
sorted in one task.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, or has a
null label or id, links with nothing; its component is its own id. Vectors of different lengths do not
link. Rows that repeat an id are vectors of their own under one id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, stored
from .components import components

PASSES = 10
BITS = 32
BLOCK = 128
WIDE = 4
WINDOW = -1
PREFIX = 12
SLICE = 8
THRESHOLD = 0.98


def projections(dim: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, PASSES * BITS))


def _keys(kind: str):
    """For mapInPandas: vectors as bytes of floats `kind`, with the keys of all passes."""
    return lambda batches: _keyed(batches, kind)


def _keyed(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[pd.DataFrame]:
    planes: dict[int, np.ndarray] = {}
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        dims = batch["vector"].map(len)
        for dim, part in batch.groupby(dims.to_numpy(), sort=True):
            if dim not in planes:
                planes[dim] = projections(int(dim))
            x = np.vstack(part["vector"].to_numpy()).astype(np.float64)
            signs = (x @ planes[dim] > 0).reshape(len(part), PASSES, BITS)
            keys = signs.astype(np.int64) @ powers
            out = part.drop(columns="vector")
            out["dim"] = np.int32(dim)
            out["raw"] = [v.tobytes() for v in x.astype(kind)]
            out["keys"] = list(keys)
            yield out


def _tile(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
    """Links that this tile is the first to see: sums of the partners' rows, and the smallest id joined to."""
    p, low, high = int(key[2]), int(key[3]), int(key[4])
    dim = int(key[1])
    width = len(tile["raw"].iat[0]) // dim
    x = np.frombuffer(b"".join(tile["raw"]), dtype=f"<f{width}").reshape(len(tile), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # no squares out of range
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    blocks, prefixes = np.vstack(tile["blocks"].to_numpy()), np.vstack(tile["keys"].to_numpy()) >> (BITS - int(tile["bits"].iat[0]))
    linked = x @ x.T >= THRESHOLD
    np.fill_diagonal(linked, False)
    own = blocks[:, p]
    i, j = np.nonzero(linked)
    if high == WINDOW:  # neighbours, but for pairs inside the last block, which are the next tile's
        fresh = (np.abs(own[i] - own[j]) <= 1) & ((own[i] != low + WIDE) | (own[j] != low + WIDE))
    else:  # a dense group: between both blocks, equal prefixes
        fresh = (own[i] != own[j]) & (prefixes[i, p] == prefixes[j, p])
    i, j = i[fresh], j[fresh]
    fresh = np.ones(len(i), dtype=bool)
    for q in range(p):
        near = np.abs(blocks[i, q] - blocks[j, q]) <= 1
        fresh &= ~(near | (prefixes[i, q] == prefixes[j, q]))
    i, j = i[fresh], j[fresh]
    mass, nodes = tile["mass"].to_numpy(dtype=np.int64), tile["node"].to_numpy(dtype=np.int64)
    links = np.bincount(i, weights=mass[j], minlength=len(tile)).astype(np.int64)
    least = nodes.copy()
    while len(i):
        before = least.copy()
        np.minimum.at(least, i, before[j])
        if (least == before).all():
            break
    hit = links > 0
    return pd.DataFrame({"class": tile["class"][hit], "links": links[hit], "node": nodes[hit], "least": least[hit]})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    x = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    fit = F.expr(
        "label is not null and vec_id is not null and size(vector) > 0"
        " and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))"
        " and exists(vector, v -> v <> 0)"
    )
    marked = x.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = marked.where("fit").select(
        "vec_id", "label", "vector",
        F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")))).alias("class"),
    )
    classes = good.groupBy("label", "class").agg(
        F.count("*").alias("mass"), F.min("vec_id").alias("node"), F.first("vector").alias("vector")
    )
    keyed = stored(
        classes.select(F.col("label").cast("long").alias("label"), "class", "mass", "node", "vector").mapInPandas(
            _keys("<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"),
            "label long, class binary, mass long, node long, dim int, raw binary, keys array<long>",
        ),
        "vectors",
    )
    placed = stored(_placed(keyed), "placed")
    tiles = _tiles(placed)
    found = stored(
        tiles.groupBy("label", "dim", "pass", "low", "high")
        .applyInPandas(_tile, "class binary, links long, node long, least long"),
        "links",
    )
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("least").alias("b"))
                        .unionByName(good.join(classes.select("class", "node"), "class").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    rows = (
        good.select("vec_id", "class").join(classes.select("class", "mass"), "class").join(sums, "class", "left")
        .select("vec_id", (F.col("mass") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        .join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    )
    bare = marked.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    return rows.unionByName(bare).select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _placed(keyed: DataFrame) -> DataFrame:
    """`keyed` with blocks, firsts and lasts: the block of each vector in every pass, and the first and last block of
    its prefix. A prefix lies within a slice, so that its ends are found where the slice was ranked."""
    passes = keyed.select("label", "dim", "class", F.posexplode("keys").alias("pass", "key")).withColumn(
        "slice", F.expr(f"shiftright(key, {BITS - min(SLICE, PREFIX)})")
    )
    counts = passes.groupBy("label", "dim", "pass", "slice").agg(F.count("*").alias("held"))
    ahead = W.partitionBy("label", "dim", "pass").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("label", "dim", "pass")
    of = F.sum("held").over(whole)
    spread = F.ceil(F.log2(of / float(BLOCK << PREFIX)))
    offsets = counts.select(
        "label", "dim", "pass", "slice", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"),
        F.least(F.lit(BITS - 1), F.lit(PREFIX) + F.greatest(F.lit(0), spread)).cast("int").alias("bits"),
    )
    slices = ["label", "dim", "pass", "slice"]
    ranked = (
        passes.withColumn("rank", F.row_number().over(W.partitionBy(*slices).orderBy("key", "class")) - 1).join(offsets, slices)
        .withColumn("block", F.expr(f"(offset + rank) div {BLOCK}")).withColumn("prefix", F.expr(f"shiftright(key, {BITS} - bits)"))
    )
    run = W.partitionBy(*slices, "prefix")
    ends = ranked.select("class", "pass", "block", "bits", F.min("block").over(run).alias("first"), F.max("block").over(run).alias("last"))
    blocks = ends.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "first", "last"))).alias("all"), F.max("bits").alias("bits"))
    each = [F.col(f"all.{c}").alias(f"{c}s") for c in ("block", "first", "last")]
    return keyed.join(blocks.select("class", *each, "bits"), "class")


def _tiles(placed: DataFrame) -> DataFrame:
    """Rows of `placed` dealt to tiles (label, dim, pass, low, high): a window from block `low` on, or two blocks further
    apart within a run of one prefix."""
    each = placed.select("*", F.posexplode(F.arrays_zip("blocks", "firsts", "lasts")).alias("pass", "at")).select(
        "*", F.col("at.blocks").alias("block"), F.col("at.firsts").alias("first"), F.col("at.lasts").alias("last"))
    start = f"block - block % {WIDE}"
    window = F.expr(f"""transform(if(block % {WIDE} = 0 and block > 0, array(block - {WIDE}, block), array({start})),
        b -> named_struct('low', b, 'high', {WINDOW}L))""")
    far = F.expr("""transform(filter(sequence(first, last), b -> abs(b - block) >= 2),
        b -> named_struct('low', least(b, block), 'high', greatest(b, block)))""")
    dealt = each.withColumn("tile", F.explode(F.concat(window, far)))
    return dealt.select("label", "dim", "pass", "tile.low", "tile.high", "class", "node", "mass", "raw", "blocks", "keys", "bits")
