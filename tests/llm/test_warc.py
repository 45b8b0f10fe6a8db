"""WARC round trips against a plain reading of the rules, on dirty pages; ranges are dealt over tasks."""

import base64
import collections
import hashlib
import random

from lectern.llm import warc


def _want(rows):
    groups = collections.defaultdict(list)
    for page, html in rows:
        groups[html or ""].append(page)
    out = collections.Counter()
    for html, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = max(known) if known else None
        data = html.encode()
        for i in ids:
            again = len(ids) > 1 and i != first
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out[i, len(data), digest, "revisit" if again else "response", first if again else None] += 1
    return out


def test_round_trip_equals_brute_force(spark):
    rng = random.Random(9)
    bodies = [None, "", "<p>a</p>", "é" * 50_000, "x" * 300_000, *["".join(rng.choices("abc <>", k=rng.randint(1, 4000))) for _ in range(40)]]
    rows = [(i if i % 11 else None, rng.choice(bodies)) for i in range(300)] + [(7, "<p>a</p>"), (7, "<p>a</p>")]
    pages = spark.createDataFrame(
        [(i, rng.choice([None, "u", "http://x/ y\n", "v" * 150_000]), h, "sha", 1, "p", 5) for i, h in rows],
        "page_id long, url string, html string, sha string, salt int, path string, n long",
    ).repartition(4)
    got = warc.round_trip(pages)
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == _want(rows)


def test_ranges_are_dealt_over_tasks(spark, tmp_path):
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefghij", k=5000))) for i in range(80)], "page_id long, url string, html string").repartition(4)
    manifest = warc.write_warc(pages, f"file://{tmp_path}")
    read = warc.read_warc(manifest, split=8192)
    ranges = sum(-(-r.length // 8192) for r in manifest.collect())
    assert read.rdd.getNumPartitions() >= ranges // 2 > 4
    assert read.selectExpr("page_id", "spark_partition_id() as p").distinct().selectExpr("count(distinct p) as n").first().n > 8
    assert read.count() == 80
