"""Queries of planning waves, reducers, gates and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracle as o
from .registry import query

PROVIDERS = ("arxiv", "crossref", "europepmc", "openalex", "openreview", "pubmed", "s2", "serply")


def _providers(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(p,) for p in PROVIDERS], "provider string")


@query("plan_known_doi", "v_files", sql="SELECT id, CASE WHEN doi IS NULL THEN 'not_applicable' ELSE 'planned' END AS disposition, lower(doi) AS doi FROM v_files")
def plan_known_doi(t: DataFrame) -> DataFrame:
    return t.select("id", F.when(F.col("doi").isNull(), "not_applicable").otherwise("planned").alias("disposition"), F.lower("doi").alias("doi"))


@query("plan_broad", "v_files", sql=f"SELECT id, p AS provider, CASE WHEN p = 'arxiv' AND year < 2016 THEN 'too_old' WHEN p = 'pubmed' AND type = 'inproceedings' THEN 'out_of_scope' ELSE 'planned' END AS disposition FROM v_files, (SELECT unnest({list(PROVIDERS)}) AS p)")
def plan_broad(t: DataFrame) -> DataFrame:
    # the matrix of every seed with the fixed list of providers
    each = t.crossJoin(F.broadcast(_providers(t)))
    return each.select("id", "provider", F.when((F.col("provider") == "arxiv") & (F.col("year") < 2016), "too_old").when((F.col("provider") == "pubmed") & (F.col("type") == "inproceedings"), "out_of_scope").otherwise("planned").alias("disposition"))


_CSL = "CASE WHEN doi IS NULL THEN 'no_identifier' WHEN id % 3 = 0 THEN 'matched' ELSE 'fallback_required' END"


@query("plan_doi_bibtex", "v_files", sql=f"SELECT id, CASE {_CSL} WHEN 'fallback_required' THEN 'planned' ELSE 'not_applicable' END AS disposition FROM v_files")
def plan_doi_bibtex(t: DataFrame) -> DataFrame:
    csl = t.where("doi is not null and id % 3 = 0").select("id", F.lit(True).alias("csl"))
    return t.join(csl, "id", "left").select("id", F.when(F.col("doi").isNotNull() & F.col("csl").isNull(), "planned").otherwise("not_applicable").alias("disposition"))


@query("doi_reduction", "v_files", sql=f"SELECT id, CASE WHEN {_CSL} = 'fallback_required' AND id % 3 = 1 THEN 'matched_bibtex' ELSE {_CSL} END AS outcome FROM v_files")
def doi_reduction(t: DataFrame) -> DataFrame:
    csl, bib = (t.where(f"doi is not null and id % 3 = {k}").select("id", F.lit(True).alias(n)) for k, n in ((0, "csl"), (1, "bib")))
    return t.join(csl, "id", "left").join(bib, "id", "left").select("id", F.when(F.col("doi").isNull(), "no_identifier").when(F.col("csl"), "matched").when(F.col("bib"), "matched_bibtex").otherwise("fallback_required").alias("outcome"))


@query("plan_expansion", "v_articles", sql="SELECT id, 'pubmed.summary' AS operation, id || '-' || k AS payload FROM v_articles, range(3) r(k) WHERE id % 5 < k + 1 AND id % 5 > 0 UNION ALL SELECT id, 'openreview.fallback', title FROM v_articles WHERE id % 5 = 0")
def plan_expansion(t: DataFrame) -> DataFrame:
    found = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("id % 5 < k + 1 and id % 5 > 0")
    detail = found.select("id", F.lit("pubmed.summary").alias("operation"), F.concat(F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("payload"))
    empty = t.join(found.select("id").distinct(), "id", "left_anti").where("id % 5 = 0").select("id", F.lit("openreview.fallback").alias("operation"), F.col("title").alias("payload"))
    return detail.unionByName(empty)


@query("plan_venue", "v_articles", sql="""WITH p AS (SELECT id, CASE id % 6 WHEN 3 THEN 0.8 WHEN 5 THEN 0.3 ELSE 0.9 END AS confidence FROM v_articles WHERE origin <> 'dblp') SELECT id, CASE WHEN confidence >= 0.5 THEN 'crossref.venue_search' ELSE 'not_applicable' END AS disposition FROM p""")
def plan_venue(t: DataFrame) -> DataFrame:
    from lectern.functions.publication import parse, prepared

    accepted = t.where("origin = 'dblp'").select("id")
    open_ = t.join(accepted, "id", "left_anti").select("id", prepared("publication").alias("s")).select("id", parse(F.col("s"))["confidence"].alias("c"))
    return open_.select("id", F.when(F.col("c") >= 0.5, "crossref.venue_search").otherwise("not_applicable").alias("disposition"))


@query("plan_html_probe", "pages", sql="SELECT page_id % 20 AS seed, sha256(url) AS url_digest, row_number() OVER (PARTITION BY page_id % 20 ORDER BY sha256(url)) - 1 AS wave FROM (SELECT DISTINCT page_id, url FROM pages) QUALIFY wave < 4")
def plan_html_probe(t: DataFrame) -> DataFrame:
    seen = t.select((F.col("page_id") % 20).alias("seed"), F.sha2("url", 256).alias("url_digest"))
    return seen.withColumn("wave", (F.row_number().over(W.partitionBy("seed").orderBy("url_digest")) - 1).cast("long")).where("wave < 4")


@query("intents", "v_files", sql="SELECT path, CASE WHEN id % 7 = 0 THEN 'REMOVE' WHEN id % 5 = 0 THEN 'UPSERT' ELSE 'KEEP' END AS intent FROM v_files")
def intents(t: DataFrame) -> DataFrame:
    have = t.where("id % 7 = 0 or id % 10 <> 0").select("path", F.sha2("title", 256).alias("have"))
    want = t.where("id % 7 <> 0").select("path", F.sha2(F.when(F.col("id") % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), 256).alias("want"))
    return have.join(want, "path", "full_outer").select("path", F.when(F.col("want").isNull(), "REMOVE").when(F.col("have") == F.col("want"), "KEEP").otherwise("UPSERT").alias("intent"))


@query("stage_validate", "v_files", sql="SELECT dir, count(*) AS files, count(*) FILTER (id % 12 = 0) AS bad FROM v_files GROUP BY dir")
def stage_validate(t: DataFrame) -> DataFrame:
    planned = t.select("path", "dir", F.sha2("title", 256).alias("digest"))
    staged = t.select("path", F.sha2(F.when(F.col("id") % 12 == 0, F.lit("damaged")).otherwise(F.col("title")), 256).alias("found"))
    return planned.join(staged, "path").groupBy("dir").agg(F.count("*").alias("files"), F.count_if(F.col("digest") != F.col("found")).alias("bad"))


@query("pass_receipt", "v_records", sql="""WITH a AS (SELECT source, work_id // 100 AS part, count(*) AS n, sha256(string_agg(work_id || ':' || seq, ',' ORDER BY work_id, seq)) AS d FROM v_records GROUP BY ALL),
b AS (SELECT source, part // 1000 AS part, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY part)) AS d FROM a GROUP BY source, part // 1000)
SELECT source, sum(n)::BIGINT AS items, sha256(string_agg(d, ',' ORDER BY part)) AS receipt FROM b GROUP BY source""")
def pass_receipt(t: DataFrame) -> DataFrame:
    """A digest of all items of a source as a tree: of the items of 100 works, of 1,000 such parts, of these. No source
    is gathered in one place."""
    def level(df: DataFrame, part, order, piece) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece"))))
        return df.groupBy("source", part.alias("next")).agg(F.sum("n").alias("n"), rows.alias("rows")).select(
            "source", F.col("next").alias("part"), "n", F.sha2(F.array_join(F.transform("rows", lambda x: x["piece"]), ","), 256).alias("d"))

    items = t.select("source", "work_id", "seq", F.lit(1).alias("n"))
    named = F.concat(F.col("work_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))
    parts = level(items, F.expr("work_id div 100"), ["work_id", "seq"], named)
    whole = level(level(parts, F.expr("part div 1000"), ["part"], F.col("d")), F.lit(0), ["part"], F.col("d"))
    return whole.select("source", F.col("n").alias("items"), F.col("d").alias("receipt"))


CAPABILITIES = (("crossref", "json", True), ("pubmed", "json", True), ("arxiv", "atom", True), ("dblp", "xml", False), ("web", "html", False))


@query("capability_join", "v_log", sql="SELECT event_id, c.media, c.plannable FROM v_log JOIN (VALUES " + ", ".join(f"({i}, '{m}', {str(p).lower()})" for i, (_, m, p) in enumerate(CAPABILITIES)) + ") c(i, media, plannable) ON event_id % 5 = c.i")
def capability_join(t: DataFrame) -> DataFrame:
    registry = t.sparkSession.createDataFrame([(i, m, p) for i, (_, m, p) in enumerate(CAPABILITIES)], "i long, media string, plannable boolean")
    return t.join(F.broadcast(registry), t["event_id"] % 5 == registry["i"]).select("event_id", "media", "plannable")


@query("request_key", "v_titles", sql=f"""SELECT id, sha256('{{"method":"GET","provider":"crossref","query":"' || {o.norm_title('title')} || '"}}') AS request_key FROM v_titles""")
def request_key(t: DataFrame) -> DataFrame:
    from lectern.functions.text import normalize_title

    q = normalize_title("title")
    return t.select("id", F.sha2(F.concat(F.lit('{"method":"GET","provider":"crossref","query":"'), q, F.lit('"}')), 256).alias("request_key"))


@query("round_budget", "v_log", sql="SELECT namespace, count(*) AS planned, least(9 + 3 + count(*) % 60, 64) AS rounds FROM v_log GROUP BY namespace")
def round_budget(t: DataFrame) -> DataFrame:
    return t.groupBy("namespace").agg(F.count("*").alias("planned")).withColumn("rounds", F.least(F.lit(9 + 3) + F.col("planned") % 60, F.lit(64).cast("long")))


# a user's log as a generation: answered requests make its manifest, what was offered leaves refunds out
_GENERATIONS = """SELECT user_id, max(value) > 30 AS complete, CAST(sum(CASE WHEN value < 0.3 THEN 1 ELSE 0 END) AS bigint) AS unresolved,
 CASE WHEN min(value) < 1.5 THEN '' ELSE {sha}(CAST(sum(event_id) AS varchar(40)){bits}) END AS completed, {sha}(CAST(sum(CASE WHEN value < 90 THEN event_id ELSE 0 END) AS varchar(40)){bits}) AS manifest,
 {sha}(CAST(sum(CASE WHEN namespace <> 'refund' OR value > 8 THEN event_id ELSE 0 END) AS varchar(40)){bits}) AS candidate FROM {log} GROUP BY user_id"""


@query("publication_gate", "v_log", sql=f"""WITH g AS ({_GENERATIONS.format(sha='sha256', bits='', log='v_log')})
SELECT user_id, CASE WHEN NOT complete THEN 'GENERATION_INCOMPLETE' WHEN unresolved > 0 THEN 'UNRESOLVED_WORK:' || unresolved WHEN length(completed) <> 64 THEN 'NO_COMPLETED_MANIFEST'
 WHEN manifest <> completed THEN 'MANIFEST_MISMATCH' WHEN candidate <> completed THEN 'CANDIDATE_MISMATCH' ELSE 'PUBLISH' END AS gate FROM g""")
def publication_gate(t: DataFrame) -> DataFrame:
    from lectern.operators.publish import candidate_block

    g = t.sparkSession.sql(_GENERATIONS.format(sha="sha2", bits=", 256", log="{log}"), log=t)
    reason = candidate_block(*[F.col(c) for c in ("complete", "unresolved", "completed", "manifest", "candidate")])
    return g.select("user_id", F.coalesce(reason, F.lit("PUBLISH")).alias("gate"))


@query("checkpoint_retention", "v_log", sql="SELECT namespace, event_id FROM (SELECT namespace, event_id, row_number() OVER (PARTITION BY namespace ORDER BY event_id DESC) AS n FROM v_log) WHERE n <= 2")
def checkpoint_retention(t: DataFrame) -> DataFrame:
    return t.withColumn("n", F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("event_id")))).where("n <= 2").select("namespace", "event_id")


@query("curated_lookup", "v_titles", sql=f"SELECT id, {o.norm_title('title')} IN (SELECT {o.norm_title('title')} FROM v_titles WHERE id % 50 = 0) AS curated FROM v_titles")
def curated_lookup(t: DataFrame) -> DataFrame:
    from lectern.functions.text import normalize_title

    norm = normalize_title("title").alias("norm")
    catalog = t.where("id % 50 = 0").select(norm).distinct().withColumn("hit", F.lit(True))
    return t.select("id", norm).join(catalog, "norm", "left").select("id", F.coalesce("hit", F.lit(False)).alias("curated"))
