"""Every corpus operator against brute force, on tables with nulls, empties, ties, repeats and clashing names."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontam, embeddings, minhash, mixing, quality, sharding, suffixes, tokens, toxicity, warc
from lectern.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, node long, key string, size string, kept string, band int"


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("an", "re", "ti", "on", "es", "the", "ou")) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, long_ = prose(80), prose(9000)
    out = [
        (None, None, None, None), (0, None, "en", None), (1, "", "en", "a"), (2, "   \n", None, "a"), (3, "one two", "de", "b"),
        (4, base, "en", "a"), (5, base, "en", "b"), (5, base, "en", "b"), (None, base, "en", "a"),
        (6, base.replace(base.split()[40], "changed"), "fr", None), (7, long_, "en", "a"), (8, long_ + " end", "en", "a"),
        (9, "naïve ßtraße \U0001f600 x́ <|endoftext|> it's", "de", "c"), (10, prose(30) + "\t" + base, "en", "a"),
    ]
    for i in range(11, 60):
        out.append((i, prose(rng.randint(1, 120)) + (" vile scum" if i % 3 == 0 else ""), rng.choice(("en", "de")), rng.choice("aaab")))
    return [(*r, 1, 0.5, 3, 4, "k", "s", "x", 7) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 1 if i % 3 == 0 else 0) for i in range(11, 60)] + [(None, 1, 1), (12, None, None), (13, 1, 0), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (7, 7), (9, None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1}


def test_toxicity(docs, labels, nothing):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    hit = {r.doc_id: r.predicted for r in got}
    assert sum(hit[i] == (i % 3 == 0) for i in range(11, 60)) >= 47
    assert toxicity.classify(nothing, labels).count() == 0
    assert toxicity.classify(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.where("score <> 0.5").count() == 0


def test_margins_are_distinct_grams():
    w = np.zeros(1 << toxicity.BITS)
    g = toxicity.grams("vile scum vile scum")
    w[g] = 1.0
    assert toxicity.margins(["vile scum vile scum", None], w, 0.25)[0] == pytest.approx(len(g) + 0.25)


def _removed(rows):
    seen = collections.Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    for d, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeats(docs, nothing, hot):
    key = lambda r: tuple(map(str, r))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(key, suffixes.remove_repeats(docs, hot).collect())) == sorted(map(key, _removed(rows)))
    assert suffixes.remove_repeats(nothing, hot).count() == 0


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeat_groups(docs, hot):
    """Every occurrence of a group holds the group's string; together they cover what is removed; none is left out."""
    texts = {r.row: (r.text or "").encode() for r in suffixes.Search(docs, hot).base.collect()}
    groups = collections.defaultdict(set)
    for r in suffixes.repeat_groups(docs, hot).collect():
        groups[r.group_id, r.n_bytes, r.maximal].add((r.row, r.start))
    covered = collections.defaultdict(set)
    for (_, n, _), where in groups.items():
        assert len(where) > 1 and len({texts[row][at : at + n] for row, at in where}) == 1 and n >= 200
        for row, at in where:
            covered[row].update(range(at, at + n))
    want = collections.Counter((n, gone) for _, n, gone, *_ in _removed([(r, t.decode()) for r, t in texts.items()]))
    assert want == collections.Counter((len(t), len(covered[r])) for r, t in texts.items())


def test_maximal_repeats():
    left, right = [b"xab", b"yab", b"zab"], [b"cdef1", b"cdef2", b"cdeg3"]
    array = suffixes.SuffixBucket(np.array([1, 1, 1]), right, left, length=5, gram=2)
    found = {(a + p, tuple(sorted(who.tolist()))) for a, p, who in array.maximal_repeats()}
    assert found == {(6, (0, 1)), (5, (0, 1, 2))}


def test_warc(spark, tmp_path):
    rows = [(1, "http://a b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "é" * 300_000), (6, "u", "same"), (6, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    manifest = warc.write_warc(pages, f"file://{tmp_path}")
    for r in warc.read_warc(manifest, split=70, with_payload=True).collect():
        got.setdefault(r.page_id, []).append(r)
        if r.record_type == "response":
            assert digest(bytes(r.payload)) == r.payload_digest and len(r.payload) == r.payload_bytes
    assert sum(map(len, got.values())) == len(rows)
    assert (got[1][0].record_type, got[1][0].refers_to, got[2][0].record_type) == ("revisit", 2, "response")
    assert (got[3][0].record_type, got[3][0].refers_to, got[None][0].refers_to) == ("revisit", 4, 2)
    assert [r.record_type for r in got[6]] == ["response", "response"] and got[5][0].payload_bytes == 600_000
    assert warc.round_trip(pages.limit(0)).count() == 0


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_false_magic(tmp_path):
    record = warc.member(warc.record(1, "u", b"payload", None, False))
    path = tmp_path / "f"
    path.write_bytes(warc.GZIP + b"junk" + record + record)
    with path.open("rb") as f:
        assert len(list(warc.members(f, 0, 10_000))) == 2
    with path.open("rb") as f:
        assert len(list(warc.members(f, 8, 10_000))) == 1


def test_quality(docs, labels, nothing):
    got = {r.doc_id: r for r in quality.classify(docs, labels, 0.9).collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert got[0].perplexity is None and got[0].kept and got[1].perplexity is None
    kept = [got[i].kept for i in range(11, 60)]
    assert 0.8 <= sum(kept) / len(kept) <= 1
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(docs, labels.where("quality = 5")).where("not kept or perplexity is not null").count() == 0


def test_decontamination(spark, docs, nothing):
    item = "Yesterday Ann bought 3 kg of apples and 12 pears at the market near Paris for Ann and her friends."
    bench = spark.createDataFrame([(1, item), (2, "short"), (None, None)], "item_id long, text string")
    rows = [
        (1, "First. " + item + " Last."), (2, item.upper()), (3, item.replace("Ann", "Eve").replace("3 kg", "7 lb").replace("Paris", "Rome")),
        (4, item.replace("for Ann", "for Bob").replace("bought", "sold").replace("near", "by")), (5, None), (None, item), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.verdict for r in decontam.contaminated(table, bench).collect()}
    assert got == {1: "verbatim", 2: "verbatim", 3: "reparameterised", None: "verbatim"}
    assert sorted(r.doc_id for r in decontam.clean(table, bench).collect()) == [4, 5, 6]
    assert decontam.clean(docs, bench).count() == docs.count() and decontam.clean(docs, bench).columns == docs.columns
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(table, bench.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog while seven wizards box nearby in silence"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = spark.createDataFrame([(1, item), (2, "nothing of the kind here at all, only other words without any meaning")], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST", 0)
    assert [r.doc_id for r in decontam.contaminated(table, bench).collect()] == [1]


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.04).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, rng.normal(size=16).tolist(), int(i % 2)) for i in range(60)] + [(2000, rows[0][1], 1), (2001, rows[0][1], 2)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1), (3005, rows[0][1], None), (None, rows[0][1], 1), (3006, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, dtype=np.float32).astype(float), label) for i, v, label in rows if i is not None and i < 3000]
    x = np.vstack([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([label for *_, label in good])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i, *_ in good])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    assert got[3002].n_links == 0 and got[3002].component_id == 3002 and got[3002].kept and got[2001].n_links == 0
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and sum(r.taken for r in v) == int(v[0].target)
        assert v[0].target <= 2 * v[0].source_size
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(nothing).count() == 0 and mixing.apply_mix(nothing).count() == 0
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    want = collections.Counter({r.doc_id: 0 for r in rows})
    got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    for r in rows:
        want[r.doc_id] += (2 * r.taken + r.size) // (2 * r.size) if r.size else 0
    assert all(abs(got[i] - want[i]) <= 2 for i in want)


def test_hilbert_curve_is_a_path(spark):
    cells = spark.range(8**2).selectExpr("cast(id div 8 as int) as x", "cast(id % 8 as int) as y")
    rows = sorted(cells.withColumn("h", sharding.hilbert(["x", "y"], 3)).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(64))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_sharding(docs, nothing):
    rows = sharding.shard_documents(docs, 7).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by[s]) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id is not None)
    assert sharding.shard_documents(nothing).count() == 0


def test_tokens(docs, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    got = sorted((tuple(r) for r in tokens.encode_documents(rows, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r.doc_id for r in rows.collect())
    texts = {r.doc_id: r.text for r in rows.collect()}
    start = 0
    for doc_id, at, n, crc in got:
        want = np.array([*t.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (at, n, crc) == (start, len(want), zlib.crc32(want.tobytes()))
        start += n
    assert tokens.encode_documents(docs, path).count() == docs.count()
    assert tokens.encode_documents(nothing, path).count() == 0


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 100_000], list(range(0, 3000, 3)), [0, 2**40]])
def test_elias_fano(values):
    ef = tokens.EliasFano.build(np.array(values))
    assert ef.values().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    assert len(ef.low) + len(ef.high) <= len(values) * (3 + max(0, (values[-1] // len(values)).bit_length())) / 8 + 8


def _classes(rows):
    bags = {}
    for i, t in rows:
        if i is not None:
            bags.setdefault(i, []).append(minhash.bag_of(t))
    parent = {i: i for i in bags}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in bags[a]:
                for y in bags[b]:
                    if (len(x[0]) == len(y[0]) == 0) or minhash.similarity(x, y) >= minhash.THRESHOLD:
                        p, q = find(a), find(b)
                        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [minhash.SMALL, 1])
def test_near_duplicates(docs, nothing, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TILE", 2)
    want = _classes([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    kept = [r.doc_id for r in minhash.deduplicate(docs).where("doc_id is not null").collect()]
    assert sorted(kept) == sorted(i for i, c in want.items() if i == c)
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.deduplicate(nothing).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        shingles = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
        a = rng.integers(0, 4, 200)
        b = np.where(rng.random(200) < 0.8, a, rng.integers(0, 40, 200))
        pair = [(shingles[w > 0], w[w > 0]) for w in (a, b)]
        s = minhash.signatures(np.repeat([0, 1], [len(p[0]) for p in pair]), *(np.concatenate(x) for x in zip(*pair)), 2)
        errors.append((s[0] == s[1]).mean() - minhash.similarity(*pair))
    assert abs(np.mean(errors)) < 0.025 and np.sqrt(np.mean(np.square(errors))) < 0.07


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and docs.count() > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
    assert docs.agg(F.max("doc_id")).first()[0] is not None


def test_hub_join_equals_a_join(spark, monkeypatch):
    from lectern.llm import common

    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, 1)], "u long, v long")
    keyed = rows.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    want = sorted(map(tuple, rows.join(keyed.drop("n"), "u").collect()))
    for hub in (1000, 50, 0):
        monkeypatch.setattr(common, "HUB", hub)
        assert sorted(map(tuple, common.hub_join(rows, keyed, ["u"]).select("u", "v", "m").collect())) == want
