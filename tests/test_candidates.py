"""Candidate pairs against all pairs of an author."""

import pytest

from lectern.operators import identity
from lectern.plans import catalog
from lectern.sources.views import VIEWS, view


@pytest.mark.parametrize("context", sorted(identity.LADDERS))
def test_candidates_miss_no_match(spark, sf_dir, context):
    files = view(spark, sf_dir, "v_files")
    every = spark.sql(VIEWS["v_pairs"], v_files=files)
    want = {(r.lid, r.rid) for r in identity.decide(every, context).where("verdict").collect()}
    found = identity.candidates(files, context)
    assert set(found.columns) == set(every.columns) and found.count() == found.select("lid", "rid").distinct().count()
    assert {(r.lid, r.rid) for r in identity.decide(found, context).where("verdict").collect()} == want


def test_candidates_edges(spark):
    rows = [(1, "abcdefgh", None), (2, "abcdefghwxyz", None), (3, "", None), (4, None, None), (5, "ring theory of everything", "10.1/a.v1"),
            (6, "ring theory of everything and a very long tail that goes on and on and on for ever", "10.1/b"), (7, "unlike", "doi:10.1/A.v2")]
    files = spark.createDataFrame([(i, "d", "k", t, "Lovelace, Ada", 2020, d, None, None, None, None) for i, t, d in rows],
                                  "id long, dir string, key string, title string, author string, year int, doi string, journal string, booktitle string, howpublished string, s2_id string")
    got = lambda context: {(r.lid, r.rid) for r in identity.candidates(files, context).collect()}
    assert got("import") == {(1, 2), (3, 4)} and got("doi_net") == {(5, 7)} and {(5, 6), (5, 7), (1, 2), (3, 4)} <= got("survivor")


def test_dedup_list_keeps_no_two_that_match(spark, sf_dir):
    files = view(spark, sf_dir.replace("sf0.001", "sf0.01"), "v_files").where("id < 300")
    matches = identity.decide(spark.sql(VIEWS["v_pairs"], v_files=files), "import").where("verdict")
    assert matches.count() > 50
    kept = {r.id for r in catalog.queries()["dedup_list"](spark, sf_dir.replace("sf0.001", "sf0.01")).where("kept").collect()}
    assert not [1 for r in matches.collect() if r.lid in kept and r.rid in kept]
