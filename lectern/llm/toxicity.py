"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes
log-count ratios, trained on labelled text.

1. Labelled documents of the training fold are drawn by hash, at most `SAMPLE` of each class (the
   documented bound of the fit).
   FEATURES, ORDERS, LEAST_DF, L2 and LIFT were chosen by cross-validation over the training folds alone.
2. Document frequencies of hashed n-grams per class are counted on the executors and give each n-gram
   its log ratio of rates; the `FEATURES` with the most evidence are kept.
   The size of the model is FEATURES, as its depth is ORDERS: a parameter of the classifier, not of the data.
3. Logistic regression (L2, L-BFGS) is fitted on presence times log ratio, in one task on an executor: the
   driver gets neither n-grams nor features of documents. The weights are folded into one array, which is sent
   to the executors (at most `FEATURES` non-zero entries).
4. Every whole text is scored.

Defined results: a null or empty text scores the bias alone; nulls among the labels are ignored, and a
document that is labelled more than once is toxic if any of its labels says so; a document whose id repeats gives
the fit its least text; with one class only, or
no labels, the score is that class's smoothed rate; rows that repeat are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
FEATURES = 50_000
ORDERS = (4,)
BITS = 22
LEAST_DF = 5
L2 = 3e-5
LIFT = 4.0
CHUNK = 1_000_000


def _codes(text: str | None) -> np.ndarray:
    folded = " " + " ".join((text or "").lower().split()) + " "
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(text: str | None) -> np.ndarray:
    """Distinct hashed character n-grams of the lower-cased text, white space folded to one blank."""
    hashes = [h for _, h in _hashes(_codes(text))]
    return np.unique(np.concatenate(hashes)).astype(np.int32) if hashes else np.zeros(0, dtype=np.int32)


def _hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield n, (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def margins(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """bias + sum of weights over the distinct n-grams of each whole text."""
    live = weights != 0
    out = np.full(len(texts), bias)
    for i, text in enumerate(texts):
        hits = [h[live[h]] for _, h in _hashes(_codes(text))]
        if hits:
            out[i] += weights[np.unique(np.concatenate(hits))].sum()
    return out


def fold(row_id: str = "doc_id") -> Column:
    return F.crc32(F.col(row_id).cast("string").cast("binary")) % 5


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the training rows: the first SAMPLE of each class by hash of doc_id."""
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(fold() != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("lot", F.xxhash64("doc_id", F.lit(7)))
    )
    picked = [known.where(F.col("toxic") == y).orderBy("lot", "doc_id").limit(SAMPLE) for y in (0, 1)]
    drawn = picked[0].unionByName(picked[1])  # 2 * SAMPLE rows at most
    # one text of each id: the bound holds however often an id repeats
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        for y, text in zip(batch["toxic"], batch["text"]):
            counts[int(y), grams(text)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    for lo in range(0, len(at), 100_000):
        part = at[lo : lo + 100_000]
        yield pd.DataFrame({"gram": part.astype(np.int32), "clean": counts[0, part], "toxic": counts[1, part]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The kept n-grams, ascending, and their ratios as one row."""
    if parts := list(batches):
        rows = pd.concat(parts).sort_values("gram")
        yield pd.DataFrame({"grams": [rows["gram"].to_numpy(np.int32).tobytes()], "ratios": [rows["ratio"].to_numpy(float).tobytes()]})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashed n-grams, their weights, bias), from the labelled rows of the training fold."""
    sample = _sample(docs, labels)
    sizes = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    nothing = np.zeros(0, dtype=np.int32), np.zeros(0)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        rate = (n1 + 1) / (n0 + n1 + 2)
        return *nothing, float(np.log(rate / (1 - rate)))
    counted = (
        sample.mapInPandas(_count_grams, "gram int, clean int, toxic int")
        .groupBy("gram").agg(F.sum("clean").alias("q"), F.sum("toxic").alias("p"))
        .where(F.col("p") + F.col("q") >= LEAST_DF)
        .withColumn("ratio", F.log((F.col("p") + 1) / (n1 + 2)) - F.log((F.col("q") + 1) / (n0 + 2)))
        .withColumn("evidence", F.abs("ratio") * F.sqrt(F.col("p") / n1 + F.col("q") / n0))
        .orderBy(F.desc("evidence"), "gram").limit(FEATURES)
        .select("gram", "ratio").mapInPandas(_packed, "grams binary, ratios binary").collect()
    )
    ids, ratio = (np.frombuffer(b"".join(r[c] for r in counted), dtype=t) for c, t in (("grams", np.int32), ("ratios", float)))
    if not len(ids):
        rate = (n1 + 1) / (n0 + n1 + 2)
        return *nothing, float(np.log(rate / (1 - rate)))
    chosen = sample.sparkSession.sparkContext.broadcast((ids, ratio))
    short = np.min_scalar_type(len(ids))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, _ = chosen.value
        keep = np.zeros(1 << BITS, dtype=bool)
        keep[ids] = True
        for batch in batches:
            found = [np.searchsorted(ids, (g := grams(t))[keep[g]]).astype(short).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "features": found})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ratio = chosen.value
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["doc_id", "toxic"], kind="stable")
        lists = [np.frombuffer(b, dtype=short) for b in rows.pop("features")]
        beta, bias = logistic(lists, ratio, rows["toxic"].to_numpy(dtype=float))
        yield pd.DataFrame({"weights": [(beta * ratio).tobytes()], "bias": [bias]})

    # one task holds the sample's features (2 * SAMPLE rows at most); the driver gets the weights alone
    rows = sample.mapInPandas(features, "doc_id long, toxic int, features binary").repartition(1)
    model = rows.mapInPandas(fitted, "weights binary, bias double").collect()[0]
    return ids, np.frombuffer(model["weights"], dtype=float), model["bias"]


def logistic(lists: list[np.ndarray], scale: np.ndarray, y: np.ndarray, l2: float = L2, lift: float = LIFT) -> tuple[np.ndarray, float]:
    """L-BFGS on mean logistic loss + l2/2 |beta|^2; row i has features `lists[i]` of value `scale`.
    A row of label 1 weighs `lift`: the rarer class keeps its say at the 0.5 threshold."""
    n, d = len(y), len(scale)
    parts, lo = [], 0  # (first row, last row, features end to end, row of each): about CHUNK features at a time
    while lo < n:
        hi, held = lo, 0
        while hi < n and (hi == lo or held + len(lists[hi]) <= CHUNK):
            held, hi = held + len(lists[hi]), hi + 1
        cols = np.concatenate(lists[lo:hi]).astype(np.int32)
        parts.append((lo, hi, cols, np.repeat(np.arange(hi - lo, dtype=np.int32), [len(x) for x in lists[lo:hi]])))
        lo = hi
    share = np.where(y > 0, lift, 1.0)
    share /= share.sum()

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, z = scale * theta[:d], np.full(n, theta[d])
        for lo, hi, cols, row in parts:
            z[lo:hi] += np.bincount(row, weights=scaled[cols], minlength=hi - lo)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        value = share @ (np.logaddexp(0, z) - y * z) + l2 / 2 * theta[:d] @ theta[:d]
        g = (p - y) * share
        grad = np.empty(d + 1)
        grad[:d] = 0
        for lo, hi, cols, row in parts:
            grad[:d] += np.bincount(cols, weights=g[lo:hi][row], minlength=d)
        grad[:d] = grad[:d] * scale + l2 * theta[:d]
        grad[d] = g.sum()
        return value, grad

    theta = np.zeros(d + 1)
    theta[d] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(120):
        q, alphas = grad.copy(), []
        for s, t, r in reversed(past):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * t
        if past:
            s, t, r = past[-1]
            q *= (s @ t) / (t @ t)
        for (s, t, r), a in zip(past, reversed(alphas)):
            q += (a - r * (t @ q)) * s
        step = 1.0 if past else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        slope = grad @ q
        while step > 1e-8:
            new, new_grad = loss(theta - step * q)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, new_grad - grad
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        done = value - new < 1e-8 * max(1, abs(value))
        theta, value, grad = theta + s, new, new_grad
        if done:
            break
    return theta[:d], float(theta[d])


def score(docs: DataFrame, ids: np.ndarray, weights: np.ndarray, bias: float, into: str = "score") -> DataFrame:
    """`docs` with a column `into`: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast((ids, weights, bias))  # FEATURES entries at most
    held: dict = {}

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if "w" not in held:
            grams_, values, held["b"] = sent.value
            held["w"] = np.zeros(1 << BITS)
            held["w"][grams_] = values
        z = margins(texts.tolist(), held["w"], held["b"])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return docs.withColumn(into, probability("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    scored = score(docs.select("doc_id", "text"), *fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted toxic."""
    return score(docs, *fit(docs, labels), into="__toxicity").where("__toxicity < 0.5").select(*docs.columns)
