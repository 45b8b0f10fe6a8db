"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

A gram is `ORDER` code points, packed exactly (21 bits each) into two longs: no two characters of any script share
a symbol, nothing is hashed, and every table grows with the corpus. Trusted texts are those whose label says
quality 1; four fifths of them (by the text's crc32, so that copies stay together) train the model and the last
fifth sets the thresholds.

1. The documents are stored once, as blocks: a block is a file of that store. The ids of the trusted ones are
   dealt to the blocks' side files, so that no text is shuffled.
2. A task counts the distinct grams of its block; their rows (block, model, gram, n of training text) are stored.
   Summed over blocks they give the training counts and the distinct grams of the corpus. Lower orders count the
   distinct symbols to the left; discounts come from counts of counts of each model and order.
3. From order 1 up, the distinct grams of the corpus meet their counts, their contexts' totals and the probability
   of their suffix by joins on (model, gram): at most one row for each symbol meets the same key.
4. The log-probabilities go back to the blocks that use them, in side files; a scoring task loads those of its
   block alone and sums over whole texts.
5. A model's threshold is the `QUANTILE` of the perplexities of its held-out trusted texts, from exact counts of
   their logarithms in steps of a thousandth. Where these are under `LEAST_HELD`, the pooled threshold (of all
   languages) stands if it is larger. Documents above it are not kept.

Defined results: a null or empty text has no perplexity and is kept; a language without trusted text, or
null, is scored by the model of all trusted text and its threshold; with no trusted text at all nothing
has a perplexity and all is kept; with none held out, training texts set the thresholds; null labels are not
trusted; rows that repeat are scored each, and are all trusted where one is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_broadcast, cut, fresh_dir, small_batches, stored
from .files import opened

ORDER = 4
HALF = 3
BITS = 21
MASK = (1 << BITS) - 1
START = MASK
SYMBOLS = 0x110000
QUANTILE = 0.995
LEAST_HELD = 200
POOLED = "*"
STEP = 1000
MERGE_AT = 1_000_000
KEY = ["model", "a", "b"]


def packed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character as (first symbols, last three symbols); a text starts after `START`s."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.full(len(points) + ORDER - 1, START, dtype=np.int64)
    s[ORDER - 1 :] = points
    a, b = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
    for k in range(ORDER):
        part = a if k < ORDER - HALF else b
        part <<= BITS
        part |= s[k : k + len(points)]
    return a, b


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    h ^= h >> np.uint64(29)
    h += b.astype(np.uint64)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _distinct(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) with their summed n. Pairs are sorted by a mix of both; should two pairs ever share a mix,
    another seed is taken."""
    if not len(a):
        return a, b, n
    for seed in range(1_000):
        h = _mixed(a, b, seed)
        order = np.argsort(h)
        h, x, y = h[order], a[order], b[order]
        first = np.r_[True, h[1:] != h[:-1]]
        if not (~first[1:] & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))).any():
            at = np.flatnonzero(first)
            return x[at], y[at], np.add.reduceat(n[order], at)
    raise RuntimeError("no seed keeps the grams apart")


def _side_file(folder: str, block: int):
    """The tables of one block's side file; none where the block has none."""
    where, plain = opened(f"{folder}/block={block}")
    for info in where.get_file_info(arrow_fs.FileSelector(plain, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                yield pq.read_table(f)


def _roles(batch: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    """0: not trusted, 1: trains the model, 2: held out for the threshold."""
    trusted = batch["id"].isin(ids).to_numpy() & ~batch["no_id"].to_numpy()
    out = np.zeros(len(batch), dtype=np.int32)
    for i in np.flatnonzero(trusted):
        out[i] = 1 if zlib.crc32((batch["text"].iat[i] or "").encode("utf-8", "surrogatepass")) % 5 else 2
    return out


def _blocks(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    held, ids = None, None
    for batch in batches:
        for block, rows in batch.groupby("block", sort=True):
            if block != held:
                found = [t["doc_id"].to_numpy() for t in _side_file(folder, block)]
                held, ids = block, np.concatenate(found) if found else np.empty(0, dtype=np.int64)
            yield int(block), rows, _roles(rows, ids)


def _count(trusted: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], list] = {}

        def merged(parts: list) -> tuple:
            return _distinct(*(np.concatenate(x) for x in zip(*parts)))

        for block, rows, roles in _blocks(batches, trusted):
            for model, at in rows.groupby("model", sort=True).indices.items():
                fresh = []
                for i in at:
                    a, b = packed(rows["text"].iat[i])
                    fresh.append((a, b, np.full(len(a), int(roles[i] == 1), dtype=np.int64)))
                parts = held.setdefault((block, model), [])
                parts.append(merged(fresh))
                if sum(len(a) for a, _, _ in parts) > MERGE_AT + 2 * len(parts[0][0]):
                    held[block, model] = [merged(parts)]
        for (block, model), parts in held.items():
            a, b, n = merged(parts)
            for lo in range(0, len(a), 100_000):
                to = slice(lo, lo + 100_000)
                yield pd.DataFrame({"block": block, "model": model, "a": a[to], "b": b[to], "n": n[to]})

    return run


def _suffix(order: int) -> list[Column]:
    """Columns a, b of the last `order` symbols."""
    if order <= HALF:
        return [F.lit(0).cast("long").alias("a"), F.col("b").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("b")]
    return [F.col("a").bitwiseAND(F.lit((1 << BITS * (order - HALF)) - 1)).alias("a"), F.col("b")]


def _context() -> list[Column]:
    """Columns a, b of the gram without its last symbol."""
    low = F.shiftleft(F.col("a").bitwiseAND(F.lit(MASK)), BITS * (HALF - 1))
    return [F.shiftright("a", BITS).alias("a"), F.shiftright("b", BITS).bitwiseOR(low).alias("b")]


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3) from counts of counts; where these are too few, 0.5, 1 and 1.5."""
    n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int, plain: float) -> Column:
        raw = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0)
        return F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(float(k)), raw))).otherwise(plain)

    return counts.groupBy("model").agg(*n).select("model", d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def _order_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, a, b, share) and, by context, (model, a, b, rest): the discounted share of a gram in its context, and
    what the context leaves to the next lower order."""
    k = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    less = counts.join(bounded_broadcast(_discounts(counts)), "model").select(*KEY, "n", k.alias("d"))
    contexts = (
        less.select("model", *_context(), "n", "d").groupBy(*KEY)
        .agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
    )
    return less, contexts


def log_probabilities(trusted: DataFrame, seen: DataFrame) -> DataFrame:
    """(model, a, b, logp) for every row of `seen` (model, a, b; distinct) whose model is in `trusted`
    (model, a, b, n; distinct, n > 0)."""
    counts, tables = {ORDER: trusted}, {}
    for order in range(ORDER - 1, 0, -1):
        longer = counts[order + 1]
        counts[order] = stored(longer.select("model", *_suffix(order)).groupBy(*KEY).agg(F.count("*").alias("n")), "counts")
    models = bounded_broadcast(trusted.select("model").distinct())
    seen = seen.join(models, "model", "left_semi")
    p = None
    for order in range(1, ORDER + 1):
        less, contexts = _order_tables(counts[order])
        here = seen.select("model", *_suffix(order))
        here = here.distinct() if order < ORDER else here
        keyed = here.join(less, KEY, "left").select(*KEY, F.coalesce(F.greatest(F.lit(0.0), F.col("n") - F.col("d")), F.lit(0.0)).alias("over"))
        names = [c.alias(f"c{i}") for i, c in enumerate(_context())]
        if order == 1:  # one context for each model
            whole = bounded_broadcast(contexts.drop("a", "b"))
            out = keyed.join(whole, "model", "left").withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            by_context = contexts.select("model", F.col("a").alias("c0"), F.col("b").alias("c1"), "total", "freed")
            out = keyed.select("*", *names).join(by_context, ["model", "c0", "c1"], "left").drop("c0", "c1")
            tail = [c.alias(f"t{i}") for i, c in enumerate(_suffix(order - 1))]
            shorter = p.select("model", F.col("a").alias("t0"), F.col("b").alias("t1"), F.col("p").alias("lower"))
            out = out.select("*", *tail).join(shorter, ["model", "t0", "t1"])
        value = F.coalesce((F.col("over") + F.col("freed") * F.col("lower")) / F.col("total"), F.col("lower"))
        p = stored(out.select(*KEY, value.alias("p")), "probabilities")
    return p.select(*KEY, F.log("p").alias("logp"))


class Table:
    """Log-probabilities of one model in one block. Distinct grams have distinct mixes under the seed kept, and every
    gram of the block is in its table, so what is looked up is exact."""

    def __init__(self, a: np.ndarray, b: np.ndarray, logp: np.ndarray):
        for self.seed in range(1_000):
            h = _mixed(a, b, self.seed)
            order = np.argsort(h)
            self.keys = h[order]
            if (self.keys[1:] != self.keys[:-1]).all():
                self.logp = logp[order]
                return
        raise RuntimeError("no seed keeps the grams apart")

    def entropy(self, text: str | None) -> float:
        a, b = packed(text)
        if not len(a):
            return np.nan
        h = _mixed(a, b, self.seed)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        if (self.keys[at] != h).any():
            raise RuntimeError("a gram of the block has no probability")
        return -float(self.logp[at].sum()) / len(a)


def _tables(folder: str, block: int) -> dict[str, Table]:
    parts: dict[str, list] = {}
    for t in _side_file(folder, block):
        frame = t.to_pandas()
        for model, rows in frame.groupby("model", sort=True):
            parts.setdefault(model, []).append(rows)
    return {
        model: Table(*(np.concatenate([x[c].to_numpy() for x in found]) for c in ("a", "b", "logp")))
        for model, found in parts.items()
    }


def _score(trusted: str, folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tables = None, {}
        for block, rows, roles in _blocks(batches, trusted):
            if block != held:
                held, tables = block, _tables(folder, block)
            out = np.full(len(rows), np.nan)
            for i, (model, text) in enumerate(zip(rows["model"], rows["text"])):
                if model in tables:
                    out[i] = tables[model].entropy(text)
            yield rows[["id", "no_id", "lang", "model"]].assign(role=roles, entropy=out)

    return run


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, model, role, log_perplexity) of every row of `docs`; role 1: trained on, 2: held out, else 0."""
    spark = docs.sparkSession
    small_batches(spark)
    store, trusted, scores = (fresh_dir(spark, kind) for kind in ("blocks", "trusted", "model"))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").write.option("compression", "zstd").parquet(store)
    block = F.regexp_extract(F.input_file_name(), r"part-(\d+)-[^/]*$", 1).cast("int").alias("block")
    blocks = spark.read.schema("doc_id long, lang string, text string").parquet(store)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = cut(blocks.select("doc_id", "lang", block).join(good, "doc_id", "left_semi"))
    known.select("doc_id", "block").distinct().repartition("block").write.partitionBy("block").parquet(trusted)
    own = bounded_broadcast(known.where("lang is not null").select("lang").distinct().withColumn("model", F.col("lang")))
    rows = blocks.select("doc_id", "lang", "text", block).join(own, "lang", "left").select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"),  # no floats in pandas
        "lang", "text", "block", F.coalesce("model", F.lit(POOLED)).alias("model"),
    )
    uses = stored(rows.mapInPandas(_count(trusted), "block int, model string, a long, b long, n long"), "grams")
    total = stored(uses.groupBy(*KEY).agg(F.sum("n").alias("n")), "totals")
    fit = total.where("n > 0")
    pooled = fit.groupBy(F.lit(POOLED).alias("model"), "a", "b").agg(F.sum("n").alias("n"))
    models = stored(fit.where(F.col("model") != POOLED).unionByName(pooled), "models")
    logp = log_probabilities(models, total.select(*KEY))
    uses.select("block", *KEY).join(logp, KEY).repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(scores)
    return rows.mapInPandas(_score(trusted, scores), "id long, no_id boolean, lang string, model string, role int, entropy double").select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "lang", "model", "role", F.when(~F.isnan("entropy"), F.col("entropy")).alias("log_perplexity")
    )


def _limits(scored: DataFrame, quantile: float) -> DataFrame:
    """(model, limit, n) of each model and of all, from the scores of the trusted rows given."""
    steps = scored.where("log_perplexity is not null").select("model", F.ceil(F.col("log_perplexity") * STEP).alias("step"))
    steps = steps.where(F.col("model") != POOLED).unionByName(steps.withColumn("model", F.lit(POOLED)))
    counts = steps.groupBy("model", "step").agg(F.count("*").alias("n"))
    upto = W.partitionBy("model").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.withColumn("run", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("model")))
        .where(F.col("run") >= F.col("all") * quantile)
        .groupBy("model").agg((F.min("step") / STEP).alias("limit"), F.max("all").alias("n"))
    )


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every row of `docs`."""
    scored = stored(perplexities(docs, labels), "scores")
    held, fit = (_limits(scored.where(F.col("role") == k), quantile) for k in (2, 1))
    both = held.select("model", F.col("limit").alias("held"), F.col("n").alias("n")).join(
        fit.select("model", F.col("limit").alias("fit")), "model", "full"
    )
    both = cut(both.select("model", F.coalesce("held", "fit").alias("own"), F.coalesce("n", F.lit(0)).alias("n")))
    pooled = both.where(F.col("model") == POOLED).select(F.col("own").alias("pooled"))
    limits = both.join(F.broadcast(pooled), how="left").select(  # one row
        "model", F.when(F.col("n") < LEAST_HELD, F.greatest("own", "pooled")).otherwise(F.col("own")).alias("limit")
    )
    return scored.join(bounded_broadcast(limits), "model", "left").select(
        "doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("limit").alias("threshold"),
        F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True)).alias("kept"),
    )
