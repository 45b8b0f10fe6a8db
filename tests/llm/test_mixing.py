"""Whole documents of the mixture, and shards along the curve, against plain Python."""

import collections
import hashlib

import pytest

from lectern.llm import mixing, sharding


def test_cut_is_exact_with_null_and_repeated_ids(spark):
    rows = [(None, "one two three four five six", "a", 1)] * 20 + [(7, f"w{i} " * 6, "b", i) for i in range(20)] + [(i, "x " * 6, "c", i % 2) for i in range(20)]
    rows += [(None, None, None, 0), (1, "", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, before int").repartition(5)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
    targets = {r.source: r.target for r in mixing.mix(docs).collect()}
    for source in ("a", "b", "c"):
        assert abs(got[source] - int(targets[source])) <= 3  # half a document
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out.collect())) == sorted(map(key, mixing.apply_mix(docs.repartition(2)).collect()))
    copies = collections.Counter(map(key, out.collect()))
    assert all(n <= 2 * collections.Counter(map(key, docs.collect()))[k] for k, n in copies.items())


def _hilbert(cell, bits):
    """Index of a cell on the curve, by integers in place."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out * 2 + (x[i] >> b & 1)
    return out


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (3, 5)])
def test_hilbert_index(spark, n, bits):
    names = [f"a{i}" for i in range(n)]
    side = 1 << bits
    cells = [(k % side, k * 7 // side % side, k * 13 // side**2 % side)[:n] for k in range(0, side**n, max(1, side**n // 500))]
    got = spark.createDataFrame(cells, ", ".join(f"{a} int" for a in names)).withColumn("h", sharding.hilbert(names, bits)).collect()
    assert all(r.h == _hilbert(tuple(r)[:n], bits) for r in got)


def test_shards_follow_the_curve(spark):
    rows = [(i if i % 9 else None, "t" * (i * i % 700), ("x", "y", None)[i % 3], ("en", "de")[i % 2], i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard long").repartition(3)
    got = sharding.place(docs.drop("shard").withColumn("size", sharding.F.octet_length("text") + 16), 7).collect()
    md5 = lambda v: hashlib.md5(str("null" if v is None else v).encode()).hexdigest()

    def codes(column):
        order = sorted({getattr(r, column) for r in got}, key=lambda v: (v is None, v))
        at, out = 0, {}
        for v in order:
            out[v] = at * 32 // len(got)
            at += sum(getattr(r, column) == v for r in got)
        return out

    import math

    source, lang = codes("source"), codes("lang")
    size = lambda r: max(0, min(31, math.floor((math.log2(max(r.size, 1)) - 4) * 2)))
    curve = lambda r: (_hilbert((source[r.source], lang[r.lang], size(r)), 5), md5(r.doc_id)[:2], md5(r.doc_id))
    ranked = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [curve(r) for r in ranked]
    assert keys == sorted(keys)
    assert [(r.shard, r.slot) for r in ranked] == [(k * 7 // 200, k - -(-(k * 7 // 200) * 200 // 7)) for k in range(200)]
