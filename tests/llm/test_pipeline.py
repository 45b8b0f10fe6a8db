"""The stages over a dirty table, each held to a plain reading of its rule on what the stage before kept."""

import collections
import os
import random

import pytest

import corpus_pipeline
from lectern.llm import minhash, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, shard int, key string, class_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = "an river stone quiet over hill under light water morning table chair window garden".split()
    prose = lambda n: " ".join(rng.choices(words, k=n)) + f" {rng.random()}"
    item = "Yesterday the old sailor carried twelve wooden boxes from the harbour to the northern lighthouse before dinner"
    base, long_ = prose(60), prose(15_000)
    rows = [(i, prose(rng.randint(8, 60)) + (" vile scum rotten liars" * 3 if i % 4 == 0 else ""), rng.choice(["en", "de", None]), rng.choice("aaab")) for i in range(120)]
    rows += [(200, base, "en", "a"), (201, base, "en", "b"), (202, base + " tail", "de", None), (202, base + " tail", "de", None), (203, f"{prose(20)} {item} {prose(20)}", "en", "a")]
    rows += [(None, None, None, None), (None, "vile scum rotten liars vile scum rotten liars", "en", "a"), (None, prose(9), "en", "a"), (204, None, "en", "a"), (205, "", None, "b"), (206, long_, "en", "b"), (207, long_ + " end", "en", "c")]
    path = str(tmp_path_factory.mktemp("dirty"))
    spark.createDataFrame([(*r, 1, 0.5, 3, 9, "k", 4) for r in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, None, None), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _key(r):
    return tuple(map(str, r))


def test_dirty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), COLUMNS)
        assert docs.columns == columns
        kept[name] = docs.collect()
    before, now = kept["documents"], kept["toxicity"]
    assert not collections.Counter(map(_key, now)) - collections.Counter(map(_key, before))
    gone = collections.Counter(map(_key, before)) - collections.Counter(map(_key, now))
    assert sum("vile" in k[1] for k in gone) >= 0.9 * sum("vile" in (r.text or "") for r in before) and sum("vile" not in k[1] for k in gone) <= 3

    before, now = now, kept["near_duplicates"]
    bags = {r.doc_id: minhash.bag_of(r.text) for r in before if r.doc_id is not None}
    parent = {i: i for i in bags}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in bags:
        for b in bags:
            if a < b and (not len(bags[a][0]) and not len(bags[b][0]) or minhash.similarity(bags[a], bags[b]) >= minhash.THRESHOLD):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert sorted(r.doc_id for r in now if r.doc_id is not None) == sorted(i for i in bags if find(i) == i)
    assert sum(r.doc_id is None for r in now) == sum(r.doc_id is None for r in before)

    before, now = now, kept["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in now} == {203} and len(now) == len(before) - 1

    before, now = now, kept["mixture"]
    sizes, took = collections.Counter(), collections.Counter()
    for rows, into in ((before, sizes), (now, took)):
        for r in rows:
            into[r.source] += len((r.text or "").split())
    for r in mixing.mix(spark.createDataFrame(before, COLUMNS)).select("source", "source_size", "target").distinct().collect():
        largest = max(len((x.text or "").split()) for x in before if x.source == r.source)
        assert sizes[r.source] == r.source_size and abs(took[r.source] - int(r.target)) <= largest / 2 + 1
    twice = collections.Counter(map(_key, before))
    assert all(n <= 2 * twice[k] for k, n in collections.Counter(map(_key, now)).items())

    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(r.doc_id) for r in now)
    counts = collections.Counter(r.shard for r in last)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(corpus_pipeline.SHARDS)) <= 1


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, os.fspath(tmp_path)).count() == 0
