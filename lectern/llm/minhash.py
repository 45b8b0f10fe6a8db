"""Near duplicates by BagMinHash over the multisets of five-word shingles.

Signature. A shingle of count w covers the unit levels (0, w] of a line; every level has its own
Poisson process of unit rate in time and each of its points falls into one of `REGISTERS` registers; a
register holds the earliest point. Two registers are equal with the probability of the weighted Jaccard
similarity. Processes are hierarchical: blocks of 2**DEPTH levels have a process of the summed rate,
which is split in halves as needed - the half that does not take the parent's first point has its own
first point at an exponential distance after it - and only intervals that reach into (0, w] and whose
first point is still earlier than the latest register are split on.

Search. Texts with the same multiset are one class, named by its smallest doc_id. Bands of registers
make candidates among the classes: all pairs of a bucket of up to `SMALL` classes; in larger buckets,
each class with the bucket's centre, which differs by band. After the links found so far are joined to
components, the classes of a larger bucket that are not in its most frequent component are compared
with all its classes of other components, so that no pair of a bucket between different components goes
untested. That is done in tiles of at most `TILE` classes or `TILE_SHINGLES` shingles a side: a text goes to
a tile once, not once for each pair, and overlaps are products of incidence matrices. Candidates are
verified on the exact multisets: shared / united >= THRESHOLD.

Defined results: null and empty texts, and those without words, are one class and link with nothing
else; a text of fewer than five words has one shingle of all its words; a null doc_id has no class and
is kept; rows that repeat a doc_id are one document, of which each different text is kept once; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, hub_join, small_batches, stored
from .components import components
from .shingles import bags, mix, packed, windows, word_hashes

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
DEPTH = 3
THRESHOLD = 0.8
SMALL = 16
TILE = 1024
TILE_SHINGLES = 400_000


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _exponential(key: np.ndarray, salt: int) -> np.ndarray:
    return -np.log(_uniform(mix(key ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Registers (texts x REGISTERS) of the multisets given by distinct (owner, shingle) and counts."""
    registers = np.full(texts * REGISTERS, np.inf)
    if not len(owner):
        return registers.reshape(texts, REGISTERS)
    latest = np.full(texts, np.inf)
    blocks = (count + (1 << DEPTH) - 1) >> DEPTH
    own, low = np.repeat(owner, blocks), np.repeat(shingle, blocks)
    weight = np.repeat(count, blocks)
    at = (np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) << DEPTH
    x = _exponential(mix(low + at.astype(np.uint64)), 1) / (1 << DEPTH)
    for depth in range(DEPTH, 0, -1):
        half = 1 << (depth - 1)
        key = mix(low + at.astype(np.uint64) * np.uint64(64) + np.uint64(depth))
        left_first = (key & np.uint64(1)) == 0
        other = x + _exponential(key, 2) / half
        right = at + half < weight
        x, own, low, weight, at = (
            np.concatenate(p) for p in (
                (np.where(left_first, x, other), np.where(left_first, other, x)[right]),
                (own, own[right]), (low, low[right]), (weight, weight[right]), (at, (at + half)[right]),
            )
        )
    leaf = mix(low * np.uint64(3) + at.astype(np.uint64) + np.uint64(0xABCDEF))
    drawn = 0
    while len(x):
        # earlier rounds draw one point of a leaf, later ones, when few texts are left, several
        many = 1 if drawn < 2 else min(16, drawn)
        steps = np.arange(drawn, drawn + many, dtype=np.uint64)
        key = mix(leaf[:, None] + steps * np.uint64(0xD1342543DE82EF95))
        gap = -np.log(_uniform(mix(key + np.uint64(5))))
        if drawn == 0:
            gap[:, 0] = 0.0  # the leaf's first point is there already
        points = x[:, None] + np.cumsum(gap, axis=1)
        slot = own[:, None] * REGISTERS + (key % np.uint64(REGISTERS)).astype(np.int64)
        early = points < latest[own][:, None]
        np.minimum.at(registers, slot[early], points[early])
        latest = registers.reshape(texts, REGISTERS).max(axis=1)
        x = points[:, -1]
        drawn += many
        live = x < latest[own]
        x, own, leaf = x[live], own[live], leaf[live]
    return registers.reshape(texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    h = np.zeros((len(registers), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(31) + bits[:, :, k])
    return h.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
        for lo, hi, data, offsets in packed(texts):
            own, shingle, count = bags(*windows(*word_hashes(data, offsets)))
            first = np.searchsorted(own, np.arange(hi - lo + 1))
            keys = band_keys(signatures(own, shingle, count, hi - lo))
            digests = [
                hashlib.blake2b(shingle[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                for a, b in zip(first[:-1], first[1:])
            ]
            yield pd.DataFrame({
                "doc_id": ids[lo:hi], "bag": digests,
                "shingles": np.bincount(own, weights=count, minlength=hi - lo).astype(np.int64),
                "bands": [k if b > a else None for k, a, b in zip(keys, first[:-1], first[1:])],
            })


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted distinct shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - shared
    return shared / union if union else 0.0


def bag_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    _, _, data, offsets = next(packed([text], 1 << 62))
    _, shingle, count = bags(*windows(*word_hashes(data, offsets)))
    return shingle, count


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: tuple = (None, None)
    for batch in batches:
        keep = np.zeros(len(batch), dtype=bool)
        for n, (b, ta, tb) in enumerate(zip(batch["b"], batch["text_a"], batch["text_b"])):
            if held[0] != b:
                held = (b, bag_of(tb))
            keep[n] = similarity(bag_of(ta), held[1]) >= THRESHOLD
        yield batch.loc[keep, ["a", "b"]]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (doc_id, text) are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .mapInPandas(_verify, "a long, b long")
    )


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row with a doc_id; class_id is the smallest doc_id that links reach."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text").where("doc_id is not null")
    signed = stored(known.mapInPandas(_sign, "doc_id long, bag binary, shingles long, bands array<long>"), "bands")
    members = signed.groupBy("bag").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1")
    nodes = stored(
        signed.where("bands is not null").groupBy("bag").agg(F.min(F.struct("doc_id", "shingles", "bands")).alias("first"))
        .select("first.doc_id", "first.shingles", "first.bands"),
        "nodes",
    )
    rows = nodes.select(F.col("doc_id").alias("node"), "shingles", F.posexplode("bands").alias("band", "key"))
    centre = F.min(F.struct(F.xxhash64("node", "band").alias("lot"), F.col("node"))).alias("centre")
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("held"), centre).where("held > 1")
    dealt = stored(
        rows.join(buckets, ["band", "key"]).select("band", "key", "node", "shingles", "held", F.col("centre.node").alias("centre")),
        "buckets",
    )
    few = dealt.where(F.col("held") <= SMALL).select("band", "key", "node")
    both = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), ["band", "key"]).where("a < b")
    large = dealt.where((F.col("held") > SMALL) & (F.col("node") != F.col("centre")))
    pairs = (
        both.select("a", "b")
        .unionByName(large.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))
        .distinct()
    )
    texts = known
    links = stored(verified(pairs, texts), "links")
    # repeated ids and equal multisets are links too
    copies = hub_join(signed.select("doc_id", "bag"), members, ["bag"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    if large.take(1):
        links = links.unionByName(stored(_open_links(dealt, components(links), texts), "links"))
    joined = components(links.unionByName(copies))
    return signed.select("doc_id").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id")
    )


def _copies(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle copy, shingles of each text): the k-th copy of a shingle in a text is a thing of its own,
    so that overlaps of multisets are overlaps of sets."""
    owners, things = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for lo, _, data, offsets in packed(texts):
        own, shingle, count = bags(*windows(*word_hashes(data, offsets)))
        copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owners.append(np.repeat(own, count) + lo)
        things.append(mix(np.repeat(shingle, count) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    owner = np.concatenate(owners)
    return owner, np.concatenate(things), np.bincount(owner, minlength=len(texts))


def overlaps(left: list[str | None], right: list[str | None], columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of every left with every right text."""
    (a, x, n), (b, y, m) = _copies(left), _copies(right)
    common = np.intersect1d(x, y)
    shared = np.zeros((len(left), len(right)))
    if len(common):
        parts = []
        for owner, thing in ((a, x), (b, y)):
            at = np.searchsorted(common, thing)
            at[at == len(common)] = 0
            hit = common[at] == thing
            order = np.argsort(at[hit], kind="stable")
            parts.append((owner[hit][order], at[hit][order]))
        for lo in range(0, len(common), columns):
            dense = []
            for (owner, at), rows in zip(parts, (len(left), len(right))):
                i, j = np.searchsorted(at, [lo, lo + columns])
                grid = np.zeros((rows, min(columns, len(common) - lo)), dtype=np.float32)
                grid[owner[i:j], at[i:j] - lo] = 1
                dense.append(grid)
            shared += dense[0] @ dense[1].T
    union = n[:, None] + m[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def _tile_links(key: tuple, minor: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
    """For each class of `minor` a link into each other component of `every` that it is similar to."""
    out = []
    if len(minor) and len(every):
        alike = overlaps(minor["text"].tolist(), every["text"].tolist()) >= THRESHOLD
        mine, theirs = minor["component"].to_numpy(), every["component"].to_numpy()
        alike &= mine[:, None] != theirs[None, :]
        i, j = np.nonzero(alike)
        _, first = np.unique(np.column_stack([i, theirs[j]]), axis=0, return_index=True) if len(i) else (None, [])
        a, b = minor["node"].to_numpy(), every["node"].to_numpy()
        out = [(min(a[i[k]], b[j[k]]), max(a[i[k]], b[j[k]])) for k in first]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _open_links(dealt: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of large buckets between a class outside the bucket's most frequent component and any class of
    another component."""
    inside = stored(
        dealt.where(F.col("held") > SMALL).join(found.withColumnRenamed("id", "node"), "node", "left")
        .select("band", "key", "node", "shingles", F.coalesce("component", "node").alias("component")),
        "open",
    )
    sizes = inside.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("shingles").alias("w"))
    main = (
        sizes.groupBy("band", "key")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w"))
        .where("parts > 1")
        .select("band", "key", F.col("top.component").alias("main"),
                F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("w") / TILE_SHINGLES)).cast("int").alias("sides"))
    )
    placed = (
        inside.join(main, ["band", "key"])
        .withColumn("side", F.pmod(F.xxhash64("node", "band"), F.col("sides")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    )
    words = texts.select(F.col("doc_id").alias("node"), "text")
    keep = [F.col(c).alias(c) for c in ("band", "key", "i", "j", "node", "component", "text")]
    minor = placed.where("component <> main").selectExpr("*", "side as i", "other as j").join(words, "node").select(*keep)
    every = placed.selectExpr("*", "other as i", "side as j").join(words, "node").select(*keep)
    tile = ["band", "key", "i", "j"]
    return minor.groupBy(*tile).cogroup(every.groupBy(*tile)).applyInPandas(_tile_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for every row; of a class, the document with the smallest doc_id is kept."""
    found = classes(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    unnamed = docs.where("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")
    )
    return found.unionByName(unnamed)


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class; where a doc_id repeats, with each of its different texts once."""
    kept = classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    once = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[c for c in docs.columns if c != "doc_id"])
    named = (
        docs.join(kept, F.col("doc_id") == F.col("__kept_id"), "left_semi")
        .withColumn("__near_copy", F.row_number().over(once)).where("__near_copy = 1").drop("__near_copy")
    )
    return named.unionByName(docs.where("doc_id is null"))
