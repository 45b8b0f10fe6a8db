"""Token files: select, ids that are null, negative, repeated or far apart, other tokenizers, and parallel reading."""

import collections
import zlib

import numpy as np
import pytest

from lectern.llm import tokens
from lectern.llm.common import fresh_dir


def test_select_of_runs():
    rng = np.random.default_rng(5)
    for top in (0, 7, 10**4, 2**50):
        values = np.sort(rng.integers(0, top + 1, 2000))
        ef = tokens.EliasFano.build(values)
        for i, j in ((0, 2000), (0, 1), (1999, 2000), (255, 257), (256, 512), (300, 1400), (5, 5)):
            assert ef.select(i, j).tolist() == values[i:j].tolist()
        assert all(ef.select(i) == values[i] for i in range(0, 2000, 37))


def _want(rows, t):
    out = collections.Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_ids_and_texts(spark, name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(name)
    t = Tokenizer.from_file(path)
    rows = [(None, "null id"), (None, None), (-(2**62), "far below"), (2**62, "far above"), (3, "same"), (3, "same"), (3, "other text"), (0, ""), (1, "  two   blanks\tand\n"), (2, "Ärger, naïve é 中文 it's 12.5 " * 400)]
    docs = spark.createDataFrame([(i, x, 1, "p", "q", 0) for i, x in rows], "doc_id long, text string, start int, path string, part string, n_docs int").repartition(3)
    got = tokens.encode_documents(docs, path).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == _want(rows, t)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    assert [r.doc_id for r in order] == [None, None, *sorted(i for i, _ in rows if i is not None)]


def test_each_file_has_a_task(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.range(400).selectExpr("id as doc_id", "concat('text of ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokens.write_tokens(docs, fresh_dir(spark, "t"), public.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = manifest.count()
    parts = tokens.read_tokens(manifest).selectExpr("spark_partition_id() as p").distinct().count()
    assert n >= 4 and parts == n
