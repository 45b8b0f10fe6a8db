"""Queries of record matching and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import policy
from lectern.functions import ids, text
from lectern.operators import cluster, fuse, identity

from . import oracle as o
from .registry import query


def _side(s: str) -> str:
    return (f"{o.norm_title(f'{s}title')} AS {s}_norm, {o.norm_title(f'{s}venue')} AS {s}_venue, coalesce(lower({s}doi), '') AS {s}_doi,"
            f" coalesce({s}journal, '') AS {s}_journal, {o.signatures(f'{s}author')} AS {s}_sigs, len(string_split({s}author, ' and ')) AS {s}_people")


FEATURES = f"""b0 AS (SELECT lid, rid, {_side('l')}, {_side('r')}, abs(lyear - ryear) AS gap, lkey = rkey AS same_key, coalesce(lauthor, '') <> '' AS has_l, coalesce(rauthor, '') <> '' AS has_r, coalesce(larxiv, '') AS larxiv, coalesce(rarxiv, '') AS rarxiv, coalesce(ls2 = rs2, false) AS ext FROM v_pairs),
b1 AS (SELECT *, {o.ratio('l_norm', 'r_norm')} AS sim, CASE WHEN l_venue = '' OR r_venue = '' THEN 0.0 ELSE {o.ratio('l_venue', 'r_venue')} END AS venue_sim,
  len(list_filter(l_sigs, lambda p: len(list_filter(r_sigs, lambda q: p.last = q.last AND {o.compatible('p.initials', 'q.initials')})) > 0)) AS hits,
  l_norm <> r_norm AND least(len(l_norm), len(r_norm)) >= 15 AND CASE WHEN len(l_norm) <= len(r_norm) THEN starts_with(r_norm, l_norm) OR ends_with(r_norm, l_norm) ELSE starts_with(l_norm, r_norm) OR ends_with(l_norm, r_norm) END AS trunc,
  regexp_replace(l_doi, '\\.v\\d+$', '') AS l_base, regexp_replace(r_doi, '\\.v\\d+$', '') AS r_base,
  {o.is_secondary('l_doi')} AS l_sec, {o.is_secondary('r_doi')} AS r_sec, {o.is_preprint_doi('l_doi')} AS l_pre, {o.is_preprint_doi('r_doi')} AS r_pre,
  {o.is_server('l_journal')} AS l_server, {o.is_server('r_journal')} AS r_server,
  (starts_with(l_norm, r_norm) AND len(r_norm) > 20) OR (starts_with(r_norm, l_norm) AND len(l_norm) > 20) AS prefix20 FROM b0),
f AS (SELECT *, hits > 0 AS shared, hits::DOUBLE / (len(l_sigs) + len(r_sigs) - hits) AS ratio, l_pre OR l_server AS l_pre_rec, r_pre OR r_server AS r_pre_rec FROM b1)"""


# The ladders once more, for DuckDB alone and with their numbers written out, so that the two texts can disagree.
_REFUSED = "CASE WHEN l_norm = '' OR r_norm = '' THEN 'MISSING_TITLE' WHEN sim < 0.55 THEN 'IDENTIFIER_TITLE_CONFLICT' END"
_SCORE = "(sim * 0.4 + ratio * 0.25 + venue_sim * 0.15 + if(ext, 0.15, 0) + CASE gap WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0 END)"
_XOR = "if(l_pre_rec <> r_pre_rec, 0.1, 0)"
_PEOPLE = "least(l_people, r_people) >= 2 AND ratio >= 0.9 AND sim >= 0.6"
_BOTH_DOIS = "(l_doi <> '' AND r_doi <> '')"
STEPS = {
    "import": f"""CASE WHEN l_norm <> '' AND l_norm = r_norm THEN CASE WHEN has_l AND has_r AND NOT shared THEN 'AUTHOR_CONFLICT' WHEN gap > 3 THEN 'YEAR_CONFLICT' ELSE '+IMPORT_EXACT_TITLE' END
 WHEN sim < 0.8 THEN 'BELOW_MIN_SIM'
 ELSE if(0.7 * sim + if(shared, 0.2, 0) + if(coalesce(gap <= 1, false), 0.2, 0) >= 0.95, '+', '') || 'IMPORT_WEIGHTED' END""",
    "enrichment": f"""CASE WHEN {_BOTH_DOIS} AND l_doi = r_doi THEN coalesce({_REFUSED}, '+DOI_EXACT')
 WHEN {_BOTH_DOIS} AND l_pre = r_pre THEN 'DOI_CONFLICT'
 WHEN larxiv <> '' AND rarxiv <> '' THEN if(larxiv = rarxiv, coalesce({_REFUSED}, '+ARXIV_EXACT'), 'ARXIV_CONFLICT')
 WHEN l_norm = '' OR r_norm = '' THEN 'MISSING_TITLE'
 WHEN ext AND sim >= 0.35 THEN '+EXTERNAL_ID'
 WHEN sim >= 0.95 THEN CASE WHEN gap > 3 THEN 'YEAR_CONFLICT' WHEN shared THEN '+HIGH_TITLE_SIM' ELSE 'AUTHOR_CONFLICT' END
 WHEN trunc AND gap > 3 THEN 'YEAR_CONFLICT' WHEN trunc AND shared THEN '+TRUNCATED_TITLE'
 WHEN sim < 0.35 THEN 'BELOW_MIN_SIM'
 WHEN l_pre_rec <> r_pre_rec OR ext OR ({_PEOPLE}) THEN if(round({_SCORE}, 9) >= 0.6, '+', '') || 'COMPOSITE'
 ELSE 'GATE_CLOSED' END""",
    "doi_net": f"""CASE WHEN NOT {_BOTH_DOIS} OR l_base <> r_base THEN 'NO_MATCH' ELSE coalesce({_REFUSED}, if(l_doi = r_doi, '+DOI_EXACT', '+DOI_VERSION')) END""",
    "survivor": f"""CASE WHEN {_BOTH_DOIS} THEN CASE
   WHEN l_base = r_base THEN coalesce({_REFUSED}, if(l_doi = r_doi, '+DOI_EXACT', '+DOI_VERSION'))
   WHEN l_sec = r_sec THEN 'DOI_CONFLICT'
   WHEN larxiv <> '' AND rarxiv <> '' AND larxiv <> rarxiv THEN 'ARXIV_CONFLICT'
   ELSE if(sim >= 0.55 AND round({_SCORE}, 9) >= 0.6, '+', '') || 'PREPRINT_PAIR' END
 WHEN ext AND sim >= 0.55 THEN '+EXTERNAL_ID'
 WHEN same_key THEN CASE WHEN sim >= 0.95 OR prefix20 THEN '+KEY_TITLE' WHEN ratio >= 0.8 AND sim >= 0.55 THEN '+KEY_AUTHOR_OVERLAP' ELSE 'NO_MATCH' END
 WHEN sim >= 0.95 THEN CASE WHEN l_doi || r_doi <> '' THEN '+HIGH_TITLE_SIM' WHEN gap > 3 THEN 'YEAR_CONFLICT' WHEN shared THEN '+HIGH_TITLE_SIM' ELSE 'AUTHOR_CONFLICT' END
 WHEN trunc AND l_doi || r_doi = '' AND gap > 3 THEN 'YEAR_CONFLICT'
 WHEN trunc AND shared THEN '+TRUNCATED_TITLE'
 WHEN {_PEOPLE} AND round({_SCORE} + {_XOR}, 9) >= 0.6 THEN '+COMPOSITE'
 WHEN sim >= 0.55 AND shared AND (l_sec OR l_server) <> (r_sec OR r_server)
   AND (((l_sec OR l_server) AND r_doi || r_journal <> '') OR ((r_sec OR r_server) AND l_doi || l_journal <> '')) THEN '+PREPRINT_RELAXED'
 ELSE 'NO_MATCH' END""",
}


def _identity_sql(context: str) -> str:
    return f"WITH {FEATURES}, s AS (SELECT lid, rid, {STEPS[context]} AS step FROM f) SELECT lid, rid, starts_with(step, '+') AS verdict, replace(step, '+', '') AS reason FROM s"


for _context in identity.LADDERS:
    query(f"identity_{_context}", "v_files", sql=_identity_sql(_context))(lambda t, c=_context: identity.decide(identity.all_pairs(t), c))


@query("dedup_score", "v_files", sql=f"WITH {FEATURES} SELECT lid, rid, round({_SCORE} + {_XOR}, 6)::DOUBLE AS score FROM f")
def dedup_score(t: DataFrame) -> DataFrame:
    return identity.features(identity.all_pairs(t)).select("lid", "rid", F.round(F.expr(f"{identity.COMPOSITE} + {identity.XOR_BONUS}").cast("double"), 6).alias("score"))


@query("candidate_score", "v_files", sql=f"WITH {FEATURES} SELECT lid, rid, CASE WHEN sim < 0.8 THEN 0.0 ELSE round(0.7 * sim + CASE WHEN shared THEN 0.2 ELSE 0 END + CASE WHEN gap <= 1 THEN 0.2 ELSE 0 END, 6) END::DOUBLE AS score FROM f")
def candidate_score(t: DataFrame) -> DataFrame:
    score = "case when sim < 0.8 then 0.0d else round(0.7d * sim + case when shared then 0.2d else 0d end + case when gap <= 1 then 0.2d else 0d end, 6) end"
    return identity.features(identity.all_pairs(t)).select("lid", "rid", F.expr(score).alias("score"))


@query("topk_candidates", "v_files", sql=f"WITH {FEATURES}, k AS (SELECT lid, rid, sim, row_number() OVER (PARTITION BY lid ORDER BY round(sim, 9) DESC, rid) AS place FROM f WHERE sim >= 0.8) SELECT lid, rid, place, round(sim, 6) AS sim FROM k WHERE place <= 5")
def topk_candidates(t: DataFrame) -> DataFrame:
    best = W.partitionBy("lid").orderBy(F.desc(F.round("sim", 9)), "rid")
    return identity.features(identity.all_pairs(t)).where("sim >= 0.8").withColumn("place", F.row_number().over(best).cast("long")).where("place <= 5").select("lid", "rid", "place", F.round("sim", 6).alias("sim"))


@query("admit_candidates", "v_files", sql=f"WITH {FEATURES}, s AS (SELECT lid, rid, {STEPS['enrichment']} AS step FROM f) SELECT lid, min(rid) AS rid FROM s WHERE starts_with(step, '+') GROUP BY lid")
def admit_candidates(t: DataFrame) -> DataFrame:
    return identity.decide(identity.all_pairs(t), "enrichment").where("verdict").groupBy("lid").agg(F.min("rid").alias("rid"))


@query("baseline_lookup", "v_files", sql=f"WITH {FEATURES}, k AS (SELECT rid, min(lid) AS lid FROM f WHERE sim >= 0.95 GROUP BY rid) SELECT rid, lid FROM k")
def baseline_lookup(t: DataFrame) -> DataFrame:
    return identity.features(identity.all_pairs(t)).where("sim >= 0.95").groupBy("rid").agg(F.min("lid").alias("lid"))


def dedup_list(files: DataFrame, pairs: DataFrame) -> DataFrame:
    order = W.partitionBy("dir").orderBy(F.desc("year"), text.normalize_title("title"), "author", "id")
    records = files.select("id", F.row_number().over(order).alias("ordinal"))
    matches = identity.decide(pairs, "import").where("verdict").select(F.col("lid").alias("a"), F.col("rid").alias("b"))
    return cluster.greedy(records, matches)


_MATCHED = "len(list_intersect(r.kept_ids, nb.m)) > 0"
query("dedup_list", "v_files", sql=f"""WITH RECURSIVE {FEATURES}, s AS (SELECT lid, rid, {STEPS['import']} AS step FROM f), hit AS (SELECT lid, rid FROM s WHERE starts_with(step, '+')),
nb AS (SELECT id, dir, row_number() OVER (PARTITION BY dir ORDER BY year DESC, {o.norm_title('title')}, author, id) AS n,
  coalesce((SELECT list(CASE WHEN lid = v.id THEN rid ELSE lid END) FROM hit WHERE lid = v.id OR rid = v.id), []) AS m FROM v_files v),
r AS (SELECT dir, n, id, true AS kept, [id] AS kept_ids FROM nb WHERE n = 1
  UNION ALL SELECT nb.dir, nb.n, nb.id, NOT {_MATCHED}, CASE WHEN {_MATCHED} THEN r.kept_ids ELSE list_append(r.kept_ids, nb.id) END FROM r JOIN nb ON nb.dir = r.dir AND nb.n = r.n + 1)
SELECT id, kept FROM r""")(lambda files: dedup_list(files, identity.candidates(files, "import")))


@query("merge_lists", "v_files", sql=f"""WITH {FEATURES}, s AS (SELECT lid, rid, {STEPS['import']} AS step FROM f)
SELECT id, dir FROM v_files WHERE id % 3 <> 0 UNION ALL SELECT id, dir FROM v_files v WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE starts_with(step, '+') AND (s.lid = v.id AND s.rid % 3 <> 0 OR s.rid = v.id AND s.lid % 3 <> 0))""")
def merge_lists(files: DataFrame) -> DataFrame:
    first, second = files.where("id % 3 <> 0"), files.where("id % 3 = 0")
    hit = identity.decide(identity.all_pairs(files), "import").where("verdict and (lid % 3 = 0) <> (rid % 3 = 0)").select(F.when(F.col("lid") % 3 == 0, F.col("lid")).otherwise(F.col("rid")).alias("id"))
    return first.select("id", "dir").unionByName(second.join(hit, "id", "left_anti").select("id", "dir"))


@query("superseded_preprints", "v_files", sql=f"""WITH {FEATURES}, s AS (SELECT lid, rid, l_pre_rec, r_pre_rec, {STEPS['survivor']} AS step FROM f)
SELECT DISTINCT id, path FROM v_files v JOIN s ON (v.id = s.lid AND l_pre_rec AND NOT r_pre_rec OR v.id = s.rid AND r_pre_rec AND NOT l_pre_rec) WHERE starts_with(step, '+')""")
def superseded_preprints(files: DataFrame) -> DataFrame:
    f = identity.features(identity.all_pairs(files)).withColumn("step", F.expr(identity.LADDERS["survivor"])).where("startswith(step, '+') and l_pre_rec <> r_pre_rec")
    old = f.select(F.when(F.col("l_pre_rec"), F.col("lid")).otherwise(F.col("rid")).alias("id"))
    return files.join(old, "id", "left_semi").select("id", "path")


_ACTION = """CASE WHEN NOT starts_with(step, '+') THEN 'DISTINCT' WHEN l_pre_rec AND NOT r_pre_rec THEN 'REPLACE' WHEN r_pre_rec AND NOT l_pre_rec THEN 'KEEP_EXISTING'
 WHEN l_doi = '' AND r_doi <> '' THEN 'REPLACE' WHEN l_doi <> '' AND r_doi = '' THEN 'KEEP_EXISTING' WHEN gap > 0 THEN 'USE_NEW_NAME' ELSE 'REUSE_KEY' END"""


@query("survivor_decision", "v_files", sql=f"WITH {FEATURES}, s AS (SELECT *, {STEPS['survivor']} AS step FROM f) SELECT lid, rid, {_ACTION} AS action FROM s")
def survivor_decision(t: DataFrame) -> DataFrame:
    return identity.features(identity.all_pairs(t)).withColumn("step", F.expr(identity.LADDERS["survivor"])).select("lid", "rid", F.expr(_ACTION.replace("starts_with", "startswith")).alias("action"))


@query("doi_net_action", "v_files", sql=f"""WITH b AS (SELECT id, dir, doi, regexp_replace(lower(doi), '\\.v\\d+$', '') AS base FROM v_files WHERE doi IS NOT NULL)
SELECT l.id AS lid, r.id AS rid, CASE WHEN l.doi = r.doi THEN 'SKIP' ELSE 'SUPERSEDE' END AS action FROM b l JOIN b r ON l.dir = r.dir AND l.base = r.base AND l.id < r.id""")
def doi_net_action(t: DataFrame) -> DataFrame:
    b = t.where("doi is not null").select("id", "dir", "doi", ids.doi_base(F.col("doi")).alias("base"))
    return b.alias("l").join(b.alias("r"), ["dir", "base"]).where("l.id < r.id").select(F.col("l.id").alias("lid"), F.col("r.id").alias("rid"), F.when(F.expr("l.doi = r.doi"), "SKIP").otherwise("SUPERSEDE").alias("action"))


@query("external_id_join", "v_files", sql="""SELECT DISTINCT l.id AS lid, r.id AS rid FROM v_files l JOIN v_files r ON l.dir = r.dir AND l.id < r.id AND (l.s2_id = r.s2_id OR l.doi = r.doi)""")
def external_id_join(t: DataFrame) -> DataFrame:
    # a union of equi-joins, not a join on a disjunction
    found = [t.alias("l").join(t.alias("r"), ["dir", k]).where("l.id < r.id").select(F.col("l.id").alias("lid"), F.col("r.id").alias("rid")) for k in ("s2_id", "doi")]
    return found[0].unionByName(found[1]).distinct()


@query("provider_search", "v_articles", "v_files", sql=f"""WITH a AS (SELECT id, {o.norm_title('title')} AS norm FROM v_articles), r AS (SELECT id AS rid, {o.norm_title('title')} AS norm FROM v_files)
SELECT a.id, r.rid FROM a JOIN r USING (norm)""")
def provider_search(articles: DataFrame, files: DataFrame) -> DataFrame:
    a = articles.select("id", text.normalize_title("title").alias("norm"))
    return a.join(files.select(F.col("id").alias("rid"), text.normalize_title("title").alias("norm")), "norm").select("id", "rid")


@query("exact_narrow", "v_pairs", sql=f"WITH n AS (SELECT lid, rid, {o.norm_title('ltitle')} = {o.norm_title('rtitle')} AS exact FROM v_pairs), m AS (SELECT *, bool_or(exact) OVER (PARTITION BY lid) AS any_exact FROM n) SELECT lid, rid FROM m WHERE exact OR NOT any_exact")
def exact_narrow(t: DataFrame) -> DataFrame:
    n = t.select("lid", "rid", (text.normalize_title("ltitle") == text.normalize_title("rtitle")).alias("exact"))
    return n.withColumn("any_exact", F.max("exact").over(W.partitionBy("lid"))).where("exact or not any_exact").select("lid", "rid")


_P = o.placeholder
_KEY = "source_rank * 10000000000000 + seq"


def _pick(f: str, cond: str = "true", key: str = _KEY) -> str:
    return f"arg_min({f}, {key}) FILTER (NOT {_P(f)} AND {cond}) AS {{0}}, arg_min(source, {key}) FILTER (NOT {_P(f)} AND {cond}) AS {{0}}_source"


_DOI_KEY = f"CASE WHEN {o.is_secondary('doi')} THEN 1 ELSE 0 END * 1000000000000000 + {_KEY}"
_V = f"""v AS (SELECT *, min(seq) FILTER (doi IS NOT NULL AND NOT {o.is_secondary('doi')}) OVER (PARTITION BY work_id) AS p,
 min(seq) FILTER ({o.is_secondary('doi')}) OVER (PARTITION BY work_id) AS s FROM v_records), w AS (SELECT *, coalesce(s < p, false) AS flagged FROM v)"""
_FUSED = f"""WITH {_V}, g AS (SELECT work_id, count(*) AS n_records, count(DISTINCT source) AS trust_hits, arg_min(type, {_KEY}) AS type,
 {_pick('booktitle').format('booktitle')}, {_pick('pages').format('pages')}, {_pick('doi', key=_DOI_KEY).format('doi')},
 {', '.join(_pick(f).format(f + '_any') + ', ' + _pick(f, 'flagged AND seq >= p').format(f + '_late') + f", coalesce(bool_or(flagged AND seq = p AND NOT {_P(f)}), false) AS {f}_at_p" for f in fuse.VERSION_FIELDS)} FROM w GROUP BY work_id)
SELECT work_id, type, n_records, trust_hits, booktitle, booktitle_source, pages, pages_source, doi, doi_source,
 {', '.join(f"CASE WHEN {f}_at_p THEN {f}_late ELSE {f}_any END AS {f}, CASE WHEN {f}_at_p THEN {f}_late_source ELSE {f}_any_source END AS {f}_source" for f in fuse.VERSION_FIELDS)} FROM g"""


@query("fused_works", "v_records", sql=_FUSED)
def fused_works(t: DataFrame) -> DataFrame:
    return fuse.fuse(t)


@query("merge_doi", "v_records", sql=f"SELECT work_id, arg_min(doi, {_DOI_KEY}) FILTER (doi IS NOT NULL) AS doi FROM v_records GROUP BY work_id")
def merge_doi(t: DataFrame) -> DataFrame:
    key = F.struct(ids.is_secondary_doi(F.col("doi")).alias("s"), "source_rank", "seq")
    return t.groupBy("work_id").agg(F.min_by("doi", F.when(F.col("doi").isNotNull(), key)).alias("doi"))


@query("merge_type", "v_records", sql="SELECT work_id, arg_max(type, -source_rank * 10000000000000 + seq) AS type FROM v_records GROUP BY work_id")
def merge_type(t: DataFrame) -> DataFrame:
    return t.groupBy("work_id").agg(F.max_by("type", F.struct(-F.col("source_rank"), "seq")).alias("type"))


_ACCEPT = {
    "title": "CASE WHEN len(b.v) < len(a.v) * 0.7 THEN a.r - b.r >= 3 ELSE a.r - b.r >= 1 END",
    "author": "CASE WHEN len(string_split(b.v, ' and ')) < len(string_split(a.v, ' and ')) THEN a.r - b.r >= 3 ELSE a.r - b.r >= 1 END",
    "journal": f"CASE WHEN {o.is_server('a.v')} = {o.is_server('b.v')} THEN a.r - b.r >= 1 ELSE {o.is_server('a.v')} END",
    "booktitle": "CASE WHEN (lower(a.v) LIKE 'lecture notes in computer science') = (lower(b.v) LIKE 'lecture notes in computer science') THEN a.r - b.r >= 1 ELSE lower(a.v) LIKE 'lecture notes in computer science' END",
}


def _fold_sql(f: str) -> str:
    return (f"SELECT work_id, w.v AS {f}, w.s AS source FROM (SELECT work_id, list_reduce(list({{'r': source_rank, 'v': {f}, 's': source}} ORDER BY seq), lambda a, b: CASE WHEN {_ACCEPT[f]} THEN b ELSE a END) AS w"
            f" FROM v_records WHERE NOT {_P(f)} GROUP BY work_id)")


for _field in fuse.GUARDS:
    query(f"merge_{_field}", "v_records", sql=_fold_sql(_field))(lambda t, f=_field: fuse.fold_field(t, f))


@query("fused_entries", "v_records", sql="SELECT w.* EXCLUDE (booktitle, booktitle_source), " + ", ".join(f"{f}.{f}, {f}.source AS {f}_source" for f in fuse.GUARDS) + " FROM (" + _FUSED + ") w "
       + " ".join(f"LEFT JOIN ({_fold_sql(f)}) {f} ON w.work_id = {f}.work_id" for f in fuse.GUARDS))
def fused_entries(t: DataFrame) -> DataFrame:
    return fuse.entries(t)


@query("provenance", "v_records", sql=f"""WITH l AS (SELECT work_id, seq, source, source_rank, unnest([{{'field': 'doi', 'value': doi}}, {{'field': 'booktitle', 'value': booktitle}}, {{'field': 'pages', 'value': pages}}], recursive := true) FROM v_records)
SELECT work_id, field, seq, source, value, row_number() OVER (PARTITION BY work_id, field ORDER BY field = 'doi' AND {o.is_secondary('value')}, source_rank, seq) = 1 AS selected FROM l WHERE NOT {_P('value')}""")
def provenance(t: DataFrame) -> DataFrame:
    return fuse.provenance(t)


@query("merge_attribution", "v_records", sql=f"""WITH l AS (SELECT work_id, seq, source, source_rank, unnest([{{'field': 'doi', 'value': doi}}, {{'field': 'booktitle', 'value': booktitle}}, {{'field': 'pages', 'value': pages}}], recursive := true) FROM v_records),
r AS (SELECT *, row_number() OVER (PARTITION BY work_id, field ORDER BY field = 'doi' AND {o.is_secondary('value')}, source_rank, seq) = 1 AS selected FROM l WHERE NOT {_P('value')})
SELECT field, source, count(*) FILTER (selected) AS won, count(*) FILTER (NOT selected) AS lost FROM r GROUP BY field, source""")
def merge_attribution(t: DataFrame) -> DataFrame:
    return fuse.provenance(t).groupBy("field", "source").agg(F.count_if("selected").alias("won"), F.count_if(~F.col("selected")).alias("lost"))


@query("trust_hits", "v_records", sql="SELECT work_id, count(DISTINCT source) AS trust_hits, " + ", ".join(f"max((source = '{s}')::INT) AS {s}" for s in policy.TRUST_ORDER) + " FROM v_records GROUP BY work_id")
def trust_hits(t: DataFrame) -> DataFrame:
    return t.groupBy("work_id").agg(F.count_distinct("source").alias("trust_hits"), *[F.max((F.col("source") == s).cast("int")).alias(s) for s in policy.TRUST_ORDER])


@query("doi_candidates", "v_records", sql=f"""WITH d AS (SELECT work_id, doi, min(seq) AS first_seq FROM v_records WHERE doi IS NOT NULL GROUP BY work_id, doi)
SELECT work_id, doi, row_number() OVER (PARTITION BY work_id ORDER BY {o.is_secondary('doi')}, first_seq) AS place FROM d""")
def doi_candidates(t: DataFrame) -> DataFrame:
    d = t.where("doi is not null").groupBy("work_id", "doi").agg(F.min("seq").alias("first_seq"))
    return d.select("work_id", "doi", F.row_number().over(W.partitionBy("work_id").orderBy(ids.is_secondary_doi(F.col("doi")), "first_seq")).cast("long").alias("place"))


@query("doi_trust_gate", "v_records", sql=f"""WITH f AS (SELECT work_id, arg_min(doi, {_DOI_KEY}) FILTER (doi IS NOT NULL) AS won FROM v_records GROUP BY work_id)
SELECT f.work_id, CASE WHEN {o.is_secondary('won')} OR bool_or(r.source_rank <= 5 AND r.doi = won) THEN won END AS doi FROM f JOIN v_records r ON f.work_id = r.work_id GROUP BY f.work_id, won""")
def doi_trust_gate(t: DataFrame) -> DataFrame:
    work = W.partitionBy("work_id")
    key = F.struct(ids.is_secondary_doi(F.col("doi")).alias("s"), "source_rank", "seq")
    won = t.withColumn("won", F.min_by("doi", F.when(F.col("doi").isNotNull(), key)).over(work))
    return won.groupBy("work_id", "won").agg(F.bool_or(F.coalesce((F.col("source_rank") <= 5) & (F.col("doi") == F.col("won")), F.lit(False))).alias("ok")).select(
        "work_id", F.when(F.col("ok") | ids.is_secondary_doi(F.col("won")), F.col("won")).alias("doi"))


@query("journal_backfill", "v_records", sql=f"""WITH f AS (SELECT work_id, arg_min(doi, {_DOI_KEY}) FILTER (doi IS NOT NULL) AS won FROM v_records GROUP BY work_id)
SELECT f.work_id, arg_min(r.journal, r.source_rank * 10000000000000 + r.seq) FILTER (r.doi = won AND r.journal IS NOT NULL AND NOT {o.is_server('r.journal')}) AS journal FROM f JOIN v_records r ON f.work_id = r.work_id GROUP BY f.work_id""")
def journal_backfill(t: DataFrame) -> DataFrame:
    from lectern.functions.venues import is_preprint_server

    work = W.partitionBy("work_id")
    key = F.struct(ids.is_secondary_doi(F.col("doi")).alias("s"), "source_rank", "seq")
    won = t.withColumn("won", F.min_by("doi", F.when(F.col("doi").isNotNull(), key)).over(work))
    fits = (F.col("doi") == F.col("won")) & F.col("journal").isNotNull() & ~is_preprint_server("journal")
    return won.groupBy("work_id").agg(F.min_by("journal", F.when(fits, F.struct("source_rank", "seq"))).alias("journal"))
