"""The fit and the scores against a plain computation on strings, with dense matrices."""

import collections
import math
import random
import zlib

import numpy as np

from lectern.llm import toxicity


def _grams(text):
    folded = " " + " ".join((text or "").lower().split()) + " "
    return {folded[i : i + n] for n in toxicity.ORDERS for i in range(len(folded) - n + 1)}


def _brute(rows, labels):
    """Scores of all rows: ratios by dictionaries, the loss minimised by Newton's method over all kept n-grams."""
    known = collections.defaultdict(set)
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            known[i].add(y)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    fit = [(_grams(min((t for t in texts[i] if t is not None), default=None)), max(ys)) for i, ys in sorted(known.items()) if i in texts]
    p, q = collections.Counter(), collections.Counter()
    for g, y in fit:
        (p if y else q).update(g)
    n1 = sum(y for _, y in fit)
    n0 = len(fit) - n1
    kept = sorted(g for g in {*p, *q} if p[g] + q[g] >= toxicity.LEAST_DF)
    ratio = {g: math.log((p[g] + 1) / (n1 + 2)) - math.log((q[g] + 1) / (n0 + 2)) for g in kept}
    x = np.array([[ratio[k] if k in g else 0.0 for k in kept] + [1.0] for g, _ in fit])
    y = np.array([float(v) for _, v in fit])
    share = np.where(y > 0, toxicity.LIFT, 1.0)
    share /= share.sum()
    penalty = np.append(np.full(len(kept), toxicity.L2), 0.0)
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        z = x @ theta
        pr = 1 / (1 + np.exp(-z))
        grad = x.T @ ((pr - y) * share) + penalty * theta
        hessian = (x * (share * pr * (1 - pr))[:, None]).T @ x + np.diag(penalty + 1e-12)
        step = np.linalg.solve(hessian, grad)
        theta -= step * min(1.0, 4 / max(np.abs(x @ step).max(), 1e-12))
    score = lambda t: 1 / (1 + math.exp(-(theta[-1] + sum(w * ratio[k] for k, w in zip(kept, theta) if k in _grams(t)))))
    return [(i, t, score(t)) for i, t in rows]


def test_scores_equal_brute_force(spark):
    rng = random.Random(6)
    mild, vile = "the fair wind blows over hills".split(), "vile scum of rotten liars".split()
    rows, labels = [], []
    for i in range(60):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choices(mild + (vile if bad else []), k=rng.randint(1, 9)))))
        labels.append((i, int(bad)))
    rows += [(3, "zz a second text of this id"), (None, "vile scum"), (100, None), (101, ""), (102, "wind " * 3000), (102, "wind " * 3000)]
    labels += [(3, 0), (None, 1), (100, 1), (101, 0), (102, None), (5, 7)]
    docs = spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], "doc_id long, text string, toxic string, score double, held_out int").repartition(3)
    got = collections.Counter((r.doc_id, r.predicted, round(r.score, 2)) for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect())
    scores = sorted((str(r.doc_id), r.score) for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect())
    want = sorted((str(i), s) for i, _, s in _brute(rows, labels))
    assert sum(got.values()) == len(rows) and [i for i, _ in scores] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(scores, want)) < 0.01


def test_features_of_documents_stay_off_the_driver(spark, monkeypatch):
    """However many rows are labelled, the driver gets a row for each class, one of n-grams and one of weights."""
    rows = [(i, ("vile scum of liars " if i % 3 == 0 else "the fair wind blows ") * (1 + i % 4)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(docs), name, lambda self, f=getattr(type(docs), name): (out := f(self), got.append(len(out)))[0])
    ids, weights, _ = toxicity.fit(docs, labels)
    assert len(ids) == len(weights) > 0 and (np.diff(ids) > 0).all()
    assert got == [2, 1, 1]
