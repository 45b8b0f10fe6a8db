"""Queries over the corpus of documents: sources and sinks, counts, integrity, order, naming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import policy
from lectern.functions import ids, people, text
from lectern.sources import bibtex

from . import oracle as o
from .registry import query

_FIELDS = {"title": "title", "author": "author", "year": "year", "journal": "journal", "booktitle": "booktitle", "doi": "doi", "volume": "volume", "howpublished": "howpublished"}


def _document(t: DataFrame):
    return bibtex.serialize(F.col("type"), F.col("key"), {k: F.col(v) for k, v in _FIELDS.items()})


def _line(name: str, raw: bool = False) -> str:
    value = f"CAST({name} AS VARCHAR)" if raw else o.latex(f"CAST({name} AS VARCHAR)")
    return f"CASE WHEN {name} IS NOT NULL THEN ',' || chr(10) || '  {name} = {{' || {value} || '}}' ELSE '' END"


_DOC = "'@' || type || '{' || key || " + " || ".join(_line(n, n in bibtex.RAW) for n in ("title", "author", "year", "journal", "booktitle", "volume", "doi", "howpublished")) + " || chr(10) || '}' || chr(10)"


@query("to_bibtex", "v_files", sql=f"SELECT id, {_DOC} AS document FROM v_files")
def to_bibtex(t: DataFrame) -> DataFrame:
    return t.select("id", _document(t).alias("document"))


@query("scan_bibtex", "v_files", sql=f"SELECT id, type, key, {o.latex('title')} AS title, {o.latex('author')} AS author, CAST(year AS VARCHAR) AS year, coalesce(doi, '') AS doi FROM v_files")
def scan_bibtex(t: DataFrame) -> DataFrame:
    docs = t.select("id", F.concat(F.lit('@comment{x}\n@string{y = "' ), F.lit('z"}\n'), _document(t)).alias("text"))
    f = lambda n: F.coalesce(F.col("fields")[n], F.lit("")).alias(n)
    return bibtex.parse(docs, "id", "text").select("id", "type", "key", f("title"), f("author"), f("year"), f("doi"))


@query("scan_directory", "v_files", sql=f"SELECT path, dir, type, key, {o.latex('title')} AS title, CAST(year AS VARCHAR) AS year FROM v_files")
def scan_directory(t: DataFrame) -> DataFrame:
    """Documents written below a folder, one a file, and read back by a scan of that folder."""
    from lectern.operators.cluster import shared_dir

    root = f"{shared_dir(t.sparkSession)}/documents-{uuid.uuid4().hex}"
    docs = t.select("path", _document(t).alias("document"))
    bibtex.write_directory(docs, root)
    found = bibtex.scan_directory(t.sparkSession, root)
    return found.select("path", "dir", "type", "key", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"))


@query("scan_bibtex_strict", "v_files", sql="SELECT id, CASE id % 4 WHEN 1 THEN 'directive' WHEN 2 THEN 'entry_count' WHEN 3 THEN 'duplicate_field,field' ELSE '' END AS violations FROM v_files")
def scan_bibtex_strict(t: DataFrame) -> DataFrame:
    doc = _document(t)
    k = F.col("id") % 4
    odd = F.when(k == 1, F.concat(F.lit("@string{a = {b}}\n"), doc)).when(k == 2, F.concat(doc, doc)).when(
        k == 3, F.replace(doc, F.lit("\n}\n"), F.lit(",\n  title = {x},\n  extra = {y}\n}\n"))).otherwise(doc)
    return bibtex.check(t.select("id", odd.alias("text")), "id", "text").select("id", F.array_join("violations", ",").alias("violations"))


@query("verify_blob_digest", "v_titles", sql="SELECT id, sha1('blob ' || octet_length(encode(title)) || chr(0) || title) AS digest FROM v_titles")
def verify_blob_digest(t: DataFrame) -> DataFrame:
    return t.select("id", F.sha1(F.concat(F.lit("blob "), F.octet_length("title").cast("string"), F.lit("\0"), F.col("title"))).alias("digest"))


@query("census_validate", "v_census", sql="""SELECT row_no, CASE WHEN scholar = '' AND dblp = '' THEN 'no_identity' WHEN enabled AND reason <> '' THEN 'enabled_with_reason' WHEN NOT enabled AND reason = '' THEN 'excluded_without_reason' WHEN scholar <> '' AND count(*) OVER (PARTITION BY scholar) > 1 THEN 'duplicate_scholar' ELSE 'ok' END AS status FROM v_census""")
def census_validate(t: DataFrame) -> DataFrame:
    return t.select("row_no", F.expr("case when scholar = '' and dblp = '' then 'no_identity' when enabled and reason <> '' then 'enabled_with_reason' when not enabled and reason = '' then 'excluded_without_reason' when scholar <> '' and count(*) over (partition by scholar) > 1 then 'duplicate_scholar' else 'ok' end").alias("status"))


@query("census_row_key", "v_census", sql="""SELECT row_no, sha256('{"dblp":"' || dblp || '","enabled":' || CASE WHEN enabled THEN 'true' ELSE 'false' END || ',"name":"' || name || '","scholar":"' || scholar || '"}') AS row_key FROM v_census""")
def census_row_key(t: DataFrame) -> DataFrame:
    return t.select("row_no", F.sha2(F.to_json(F.struct("dblp", "enabled", "name", "scholar")), 256).alias("row_key"))


@query("census_totals", "v_census", sql="SELECT count(*) AS n_rows, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS excluded FROM v_census")
def census_totals(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("n_rows"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("excluded"))


@query("author_counts", "v_files", sql="SELECT coalesce(dir, 'total') AS dir, count(*) AS n FROM v_files GROUP BY ROLLUP (dir)")
def author_counts(t: DataFrame) -> DataFrame:
    return t.rollup("dir").count().select(F.coalesce("dir", F.lit("total")).alias("dir"), F.col("count").alias("n"))


@query("baseline_counts", "v_files", sql="""SELECT '{"authors":{' || string_agg('"' || dir || '":' || n, ',' ORDER BY dir) || '},"total":' || sum(n) || '}' AS baseline FROM (SELECT dir, count(*) AS n FROM v_files GROUP BY dir)""")
def baseline_counts(t: DataFrame) -> DataFrame:
    each = t.groupBy("dir").agg(F.count("*").alias("n"))  # a row per author
    return each.agg(F.array_sort(F.collect_list(F.struct("dir", "n"))).alias("a"), F.sum("n").alias("total")).select(
        F.to_json(F.struct(F.map_from_entries("a").alias("authors"), "total")).alias("baseline"))


@query("incoherent_doi", "v_files", sql=f"""SELECT doi, count(DISTINCT {o.norm_title('title')} || '|' || year) AS versions, count(DISTINCT dir) AS dirs FROM v_files WHERE doi IS NOT NULL GROUP BY doi HAVING count(DISTINCT {o.norm_title('title')} || '|' || year) > 1""")
def incoherent_doi(t: DataFrame) -> DataFrame:
    return t.where("doi is not null").groupBy("doi").agg(
        F.count_distinct(F.struct(text.normalize_title("title"), "year")).alias("versions"), F.count_distinct("dir").alias("dirs")).where("versions > 1")


_RICH = " + ".join(f"({c} IS NOT NULL AND trim(CAST({c} AS varchar(99))) <> '')::INT" for c in _FIELDS)


@query("richest_copy", "v_files", sql=f"SELECT doi, arg_min(path, (20 - ({_RICH})) * 100000000 + id) AS path, max({_RICH}) AS richness FROM v_files WHERE doi IS NOT NULL GROUP BY doi")
def richest_copy(t: DataFrame) -> DataFrame:
    rich = F.size(F.filter(F.array(*[F.col(c).cast("string") for c in _FIELDS]), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return t.where("doi is not null").withColumn("r", rich).groupBy("doi").agg(F.min_by("path", F.struct(-F.col("r"), "id")).alias("path"), F.max("r").alias("richness"))


@query("doi_survivors", "v_files", sql="SELECT dir, doi, path FROM (SELECT dir, doi, path, row_number() OVER (PARTITION BY dir, doi ORDER BY id % 2, path, key) AS n FROM v_files WHERE doi IS NOT NULL) WHERE n = 1")
def doi_survivors(t: DataFrame) -> DataFrame:
    return t.where("doi is not null").groupBy("dir", "doi").agg(F.min_by("path", F.struct(F.col("id") % 2, "path", "key")).alias("path"))


@query("joint_output", "v_files", sql=f"""WITH w AS (SELECT *, CASE WHEN doi IS NULL THEN {o.norm_title('title')} ELSE regexp_replace(lower(doi), '\\.v\\d+$', '') END AS same FROM v_files WHERE year >= 2018),
k AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY path) AS n FROM w), f AS (SELECT id, key || '-' || year AS fname, path FROM k WHERE n = 1)
SELECT id, fname || CASE WHEN row_number() OVER (PARTITION BY fname ORDER BY path) > 1 THEN '_' || row_number() OVER (PARTITION BY fname ORDER BY path) ELSE '' END || '.bib' AS file FROM f""")
def joint_output(t: DataFrame) -> DataFrame:
    same = F.when(F.col("doi").isNull(), text.normalize_title("title")).otherwise(ids.doi_base(F.col("doi")))
    one = t.where("year >= 2018").withColumn("n", F.row_number().over(W.partitionBy(same).orderBy("path"))).where("n = 1")
    named = one.select("id", "path", F.concat("key", F.lit("-"), F.col("year").cast("string")).alias("fname"))
    place = F.row_number().over(W.partitionBy("fname").orderBy("path"))
    return named.select("id", F.concat("fname", F.when(place > 1, F.concat(F.lit("_"), place.cast("string"))).otherwise(""), F.lit(".bib")).alias("file"))


@query("corpus_integrity", "v_files", sql="SELECT dir, doi, count(*) AS n FROM v_files WHERE doi IS NOT NULL AND NOT starts_with(doi, '10.48550/arxiv') GROUP BY dir, doi HAVING count(*) > 1")
def corpus_integrity(t: DataFrame) -> DataFrame:
    return t.where("doi is not null and not startswith(doi, '10.48550/arxiv')").groupBy("dir", "doi").agg(F.count("*").alias("n")).where("n > 1")


@query("exact_identifiers", "v_files", sql=f"SELECT id, CASE WHEN doi IS NOT NULL AND NOT {o.is_secondary('doi')} THEN doi END AS primary_doi, CASE WHEN {o.is_secondary('doi')} THEN doi END AS secondary_doi, nullif(regexp_extract(coalesce(doi, ''), '10\\.48550/arxiv\\.([0-9]{{4}}\\.[0-9]{{4,5}})', 1), '') AS arxiv, s2_id FROM v_files")
def exact_identifiers(t: DataFrame) -> DataFrame:
    sec = ids.is_secondary_doi(F.col("doi"))
    return t.select("id", F.when(~sec, F.col("doi")).alias("primary_doi"), F.when(sec, F.col("doi")).alias("secondary_doi"), ids.find_arxiv("doi").alias("arxiv"), "s2_id")


@query("publication_key", "v_files", sql=f"SELECT id, sha256(dir || chr(0) || coalesce(lower(doi), s2_id, {o.norm_title('title')})) AS key FROM v_files")
def publication_key(t: DataFrame) -> DataFrame:
    return t.select("id", F.sha2(F.concat("dir", F.lit("\0"), F.coalesce(ids.norm_doi("doi"), "s2_id", text.normalize_title("title"))), 256).alias("key"))


@query("set_digest", "v_files", sql="SELECT dir, sha256(string_agg(d, chr(10) ORDER BY d)) AS digest FROM (SELECT dir, sha256(path || '|' || title) AS d FROM v_files) GROUP BY dir")
def set_digest(t: DataFrame) -> DataFrame:
    return t.select("dir", F.sha2(F.concat("path", F.lit("|"), "title"), 256).alias("d")).groupBy("dir").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("digest"))


@query("article_order", "v_articles", sql=f"SELECT id, row_number() OVER (PARTITION BY author_id ORDER BY CASE WHEN year = 2000 THEN 0 ELSE 1 END, -year, {o.norm_title('title')}, authors, id) AS place FROM v_articles")
def article_order(t: DataFrame, current_year: int = 2000) -> DataFrame:
    order = W.partitionBy("author_id").orderBy(F.when(F.col("year") == current_year, 0).otherwise(1), F.desc("year"), text.normalize_title("title"), "authors", "id")
    return t.select("id", F.row_number().over(order).cast("long").alias("place"))


@query("author_priority", "v_articles", sql="WITH a AS (SELECT author_id, count(*) AS n, bool_or(origin = 'existing' AND id % 50 = 0) AS has_output FROM v_articles GROUP BY author_id) SELECT author_id, n, has_output, row_number() OVER (ORDER BY has_output, n DESC, author_id) AS place FROM a")
def author_priority(t: DataFrame) -> DataFrame:
    a = t.groupBy("author_id").agg(F.count("*").alias("n"), F.bool_or(F.expr("origin = 'existing' and id % 50 = 0")).alias("has_output"))
    return a.withColumn("place", F.row_number().over(W.orderBy("has_output", F.desc("n"), "author_id")).cast("long"))  # a row per author


@query("plan_limit", "v_articles", sql="SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY author_id ORDER BY year DESC, id) AS n FROM v_articles) WHERE n <= 50")
def plan_limit(t: DataFrame) -> DataFrame:
    return t.withColumn("n", F.row_number().over(W.partitionBy("author_id").orderBy(F.desc("year"), "id"))).where("n <= 50").select("id")


@query("year_window", "v_articles", sql="SELECT id, year FROM v_articles WHERE year >= 1997 UNION ALL SELECT id, 0 FROM v_articles WHERE year < 1993")
def year_window(t: DataFrame) -> DataFrame:
    seen = t.select("id", F.when(F.col("year") < 1993, 0).otherwise(F.col("year")).alias("year"))
    return seen.where("year = 0 or year >= 1997")


@query("list_union", "v_articles", sql="SELECT origin, year, count(*) AS n FROM v_articles GROUP BY origin, year")
def list_union(t: DataFrame) -> DataFrame:
    parts = [t.where(F.col("origin") == s).select("origin", "year") for s in ("scholar", "dblp", "existing")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).groupBy("origin", "year").agg(F.count("*").alias("n"))


@query("membership_check", "v_articles", sql="SELECT id FROM v_articles WHERE id % 10 = 3 OR id % 10 = 7")
def membership_check(t: DataFrame) -> DataFrame:
    planned, seen = t.where("id % 10 <> 3").select("id"), t.where("id % 10 <> 7").select("id")
    return planned.exceptAll(seen).unionByName(seen.exceptAll(planned))


@query("distinct_ordered", "v_records", sql="SELECT work_id, string_agg(source, ',' ORDER BY f) AS sources FROM (SELECT work_id, source, min(seq) AS f FROM v_records GROUP BY work_id, source) GROUP BY work_id")
def distinct_ordered(t: DataFrame) -> DataFrame:
    return t.groupBy("work_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"])), ",").alias("sources"))


@query("root_children_check", "v_files", sql="SELECT DISTINCT dir FROM v_files WHERE dir NOT IN ('author-1', 'author-2')")
def root_children_check(t: DataFrame) -> DataFrame:
    allowed = t.where("dir in ('author-1', 'author-2')").select("dir")
    return t.select("dir").distinct().join(allowed, "dir", "left_anti")


@query("best_item", "v_records", sql="SELECT work_id, arg_min(seq, -length(title) * 10000000000000 + seq) AS seq FROM v_records WHERE length(title) > 12 GROUP BY work_id")
def best_item(t: DataFrame) -> DataFrame:
    return t.where("length(title) > 12").groupBy("work_id").agg(F.min_by("seq", F.struct(-F.length("title"), "seq")).alias("seq"))


@query("citekey", "v_files", sql="""SELECT id, CASE WHEN contains(n, ',') THEN lower(regexp_replace(strip_accents(split_part(n, ',', 1)), '[^A-Za-z]', '', 'g')) ELSE lower(regexp_replace(strip_accents(string_split(n, ' ')[-1]), '[^A-Za-z]', '', 'g')) END || year || ':' || array_to_string(list_transform(list_filter(string_split(regexp_replace(trim(title), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: lower(w) NOT IN ('a', 'an', 'the', 'of', 'in'))[1:4], lambda w: upper(w[1]) || w[2:]), '') AS key FROM (SELECT *, split_part(author, ' and ', 1) AS n FROM v_files)""")
def citekey(t: DataFrame) -> DataFrame:
    last = F.lower(F.regexp_replace(text.strip_accents(people.last_name(F.get(people.parse_authors("author"), F.lit(0)))), "[^A-Za-z]", ""))
    words = F.filter(F.split(F.regexp_replace(F.trim("title"), "[^A-Za-z0-9]+", " "), " "), lambda w: ~F.lower(w).isin("a", "an", "the", "of", "in"))
    short = F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))), "")
    return t.select("id", F.concat(last, F.col("year").cast("string"), F.lit(":"), short).alias("key"))


@query("key_disambiguate", "v_files", sql="SELECT id, key || CASE WHEN row_number() OVER (PARTITION BY dir, key ORDER BY id) > 1 THEN '-' || row_number() OVER (PARTITION BY dir, key ORDER BY id) ELSE '' END AS key FROM v_files")
def key_disambiguate(t: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("dir", "key").orderBy("id"))
    return t.select("id", F.concat("key", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")).alias("key"))


@query("is_complete", "v_files", sql=f"SELECT id, doi IS NOT NULL AND NOT {o.is_secondary('doi')} AND type <> 'misc' AND volume IS NOT NULL AND coalesce(journal, booktitle) IS NOT NULL AND NOT {o.is_server('journal')} AND contains(author, ' and ') AND year BETWEEN 1900 AND 2099 AS complete FROM v_files")
def is_complete(t: DataFrame) -> DataFrame:
    from lectern.functions.venues import is_preprint_server

    c = (F.col("doi").isNotNull() & ~ids.is_secondary_doi(F.col("doi")) & (F.col("type") != "misc") & F.col("volume").isNotNull()
         & F.coalesce("journal", "booktitle").isNotNull() & ~is_preprint_server("journal") & (F.size(people.parse_authors("author")) > 1) & F.col("year").between(policy.YEAR_MIN, policy.YEAR_MAX))
    return t.select("id", c.alias("complete"))


@query("looks_published", "v_files", sql=f"SELECT id, (doi IS NOT NULL AND NOT {o.is_secondary('doi')}) OR (coalesce(journal, booktitle) IS NOT NULL AND NOT {o.is_server('journal')}) AS published FROM v_files")
def looks_published(t: DataFrame) -> DataFrame:
    from lectern.functions.venues import is_preprint_server

    return t.select("id", ((F.col("doi").isNotNull() & ~ids.is_secondary_doi(F.col("doi"))) | (F.coalesce("journal", "booktitle").isNotNull() & ~is_preprint_server("journal"))).alias("published"))


@query("title_is_venue", "v_files", sql=f"SELECT id FROM v_files WHERE {o.norm_title('title')} = {o.norm_title('coalesce(journal, booktitle)')} OR id % 100 = 0")
def title_is_venue(t: DataFrame) -> DataFrame:
    venue = F.when(F.col("id") % 100 == 0, F.upper("title")).otherwise(F.coalesce("journal", "booktitle"))
    return t.where(text.normalize_title("title") == text.normalize_title(venue)).select("id")


@query("corpus_articles", "v_files", sql="SELECT id, title, author AS authors, year, coalesce(journal, booktitle, howpublished) AS publication, 'existing' AS origin FROM v_files")
def corpus_articles(t: DataFrame) -> DataFrame:
    return t.select("id", "title", F.col("author").alias("authors"), "year", F.coalesce("journal", "booktitle", "howpublished").alias("publication"), F.lit("existing").alias("origin"))


@query("orphans", "v_files", sql="SELECT path FROM v_files WHERE id % 8 = 0")
def orphans(t: DataFrame) -> DataFrame:
    return t.select("path").join(t.where("id % 8 <> 0").select("path"), "path", "left_anti")


@query("summary_upsert", "v_records", sql="SELECT work_id, arg_max(source, seq) AS source, max(seq) AS seq FROM v_records GROUP BY work_id")
def summary_upsert(t: DataFrame) -> DataFrame:
    return t.groupBy("work_id").agg(F.max_by("source", "seq").alias("source"), F.max("seq").alias("seq"))


@query("summary_reconcile", "v_files", sql="SELECT path FROM v_files WHERE id % 6 <> 0")
def summary_reconcile(t: DataFrame) -> DataFrame:
    return t.select("path").join(t.where("id % 6 <> 0").select("path"), "path", "left_semi")


@query("summary_retarget", "v_files", sql="SELECT id, CASE WHEN id % 5 = 0 THEN dir || '/renamed-' || id || '.bib' ELSE path END AS path FROM v_files")
def summary_retarget(t: DataFrame) -> DataFrame:
    renamed = t.where("id % 5 = 0").select(F.col("path").alias("old"), F.concat("dir", F.lit("/renamed-"), F.col("id").cast("string"), F.lit(".bib")).alias("new"))
    return t.join(renamed, t["path"] == renamed["old"], "left").select("id", F.coalesce("new", "path").alias("path"))


@query("inventory_paging", "v_articles", sql="""WITH p AS (SELECT author_id, id, year, (row_number() OVER (PARTITION BY author_id ORDER BY year DESC, id) - 1) // 100 AS page FROM v_articles),
m AS (SELECT author_id, min(page) AS stop FROM (SELECT author_id, page, max(year) AS newest, count(*) AS n FROM p GROUP BY author_id, page) WHERE newest < 1996 AND n = 100 GROUP BY author_id)
SELECT p.author_id, p.id, p.page FROM p LEFT JOIN m USING (author_id) WHERE p.page < 10 AND p.page <= coalesce(stop, 10)""")
def inventory_paging(t: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("author_id").orderBy(F.desc("year"), "id"))
    p = t.select("author_id", "id", "year", F.floor((n - 1) / 100).alias("page"))
    full = p.groupBy("author_id", "page").agg(F.max("year").alias("newest"), F.count("*").alias("k")).where("newest < 1996 and k = 100")
    stop = full.groupBy("author_id").agg(F.min("page").alias("stop"))
    return p.join(stop, "author_id", "left").where("page < 10 and page <= coalesce(stop, 10)").select("author_id", "id", "page")


@query("inventory_union", "v_files", sql=f"SELECT dir, {o.norm_title('title')} AS norm, count(*) AS n, arg_min(doi, id) FILTER (doi IS NOT NULL) AS doi, arg_min(volume, id) FILTER (volume IS NOT NULL) AS volume, arg_min(author, -len(string_split(author, ' and ')) * 100000000 + id) AS author FROM v_files GROUP BY ALL")
def inventory_union(t: DataFrame) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return t.groupBy("dir", text.normalize_title("title").alias("norm")).agg(
        F.count("*").alias("n"), first("doi"), first("volume"), F.min_by("author", F.struct(-F.size(people.parse_authors("author")), "id")).alias("author"))


@query("batch_correlate", "v_articles", sql="SELECT id, CASE WHEN id % 9 = 4 THEN 'missing' WHEN id % 11 = 5 THEN 'extra' WHEN id % 13 = 6 THEN 'duplicate' ELSE 'ok' END AS status FROM v_articles")
def batch_correlate(t: DataFrame) -> DataFrame:
    asked = t.where("id % 9 = 4 or id % 11 <> 5").select("id")
    got = t.where("id % 9 <> 4").select("id")
    got = got.unionByName(got.where("id % 13 = 6")).groupBy("id").agg(F.count("*").alias("n"))
    return asked.withColumn("asked", F.lit(True)).join(got, "id", "full_outer").select(
        "id", F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("status"))


@query("member_resolution", "v_census", "v_files", sql="SELECT DISTINCT c.row_no, f.dir FROM v_census c JOIN v_files f ON 'author-' || c.row_no = f.dir WHERE c.enabled")
def member_resolution(c: DataFrame, f: DataFrame) -> DataFrame:
    return c.where("enabled").select("row_no", F.concat(F.lit("author-"), F.col("row_no").cast("string")).alias("dir")).join(f.select("dir").distinct(), "dir").select("row_no", "dir")


@query("author_filter", "v_files", sql="SELECT id FROM v_files WHERE contains(lower(strip_accents(author)), 'knuth')")
def author_filter(t: DataFrame) -> DataFrame:
    target = people.signature(F.lit("Knuth, Donald E."))
    names = people.signatures(people.parse_authors("author"))
    return t.where(F.exists(names, lambda s: (s["last"] == target["last"]) & (F.startswith(s["initials"], target["initials"]) | F.startswith(target["initials"], s["initials"])))).select("id")


@query("filename_assign", "v_files")
def filename_assign(t: DataFrame) -> DataFrame:
    """A file name per entry: as many title words as it takes to be the first with that name in its folder."""
    words = F.split(text.normalize_title("title"), " ")
    names = [F.concat_ws("-", F.col("key"), F.col("year").cast("string"), F.array_join(F.slice(words, 1, n), "-")) for n in range(2, 8)]
    out = t.select("id", "dir", *[x.alias(f"n{i}") for i, x in enumerate(names)])
    for i in range(len(names)):
        out = out.withColumn(f"r{i}", F.row_number().over(W.partitionBy("dir", f"n{i}").orderBy("id")))
    pick = F.coalesce(*[F.when(F.col(f"r{i}") == 1, F.col(f"n{i}")) for i in range(len(names))], F.concat_ws("-", f"n{len(names) - 1}", F.col("id").cast("string")))
    return out.select("id", "dir", pick.alias("file"))
