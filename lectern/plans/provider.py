"""Queries of provider decoding, projection and the clean-up of merged entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import ids, people, publication, text, venues
from lectern.operators import rules
from lectern.sources import providers

from . import oracle as o
from .registry import query

_CROSSREF = """'{"DOI":"' || upper(coalesce(doi, '')) || '","title":["' || title || '"],"issued":{"date-parts":[[' || CAST(year AS varchar(9)) || ',1]]},"container-title":["",""],"event":{"name":"' || coalesce(booktitle, '') || '"}}'"""
_OPENALEX = """'{"doi":"https://doi.org/' || coalesce(doi, '') || '","title":"' || title || '","publication_year":' || CAST(year AS varchar(9)) || ',"primary_location":{"source":{"display_name":"' || coalesce(journal, '') || '"}}}'"""
_S2 = """'{"title":"' || title || '","year":' || CAST(year AS varchar(9)) || ',"externalIds":{"DOI":"' || coalesce(doi, '') || '"},"venue":"","journal":{"name":"' || coalesce(journal, '') || '"}}'"""

for _name, _json, _venue in (("crossref", _CROSSREF, "booktitle"), ("openalex", _OPENALEX, "journal"), ("s2", _S2, "journal")):
    query(f"project_{_name}", "v_files", sql=f"SELECT id, title, CAST(year AS VARCHAR) AS year, lower(doi) AS doi, {_venue} AS venue FROM v_files")(
        lambda t, n=_name, j=_json: providers.replay(t.select("id", F.expr(j).alias("body")), n)
    )


# bodies of providers, built from the records; fields that a provider has not are left out
_NAME_LIST = """array_join(transform(split(author, ' and '), n -> '{{"{0}":"' || n || '"}}'), ',')"""
_BODIES = {
    "pubmed": "'{\"title\":\"' || title || '\",\"pubdate\":\"' || year || ' Jan 3\",\"elocationid\":\"doi: ' || coalesce(doi, 'none') || '\",\"source\":\"' || coalesce(journal, '') || '\",\"volume\":\"' || coalesce(volume, '') || '\",\"pubtype\":[\"Journal Article\"],\"authors\":[' || names || ']}'",
    "europepmc": "'{\"title\":\"' || title || '\",\"pubYear\":\"' || year || '\",\"journalTitle\":\"' || coalesce(journal, '') || '\",\"pageInfo\":\"1-9\",\"authorString\":\"' || replace(replace(author, ',', ''), ' and ', ', ') || '.\"}'",
    "csl": "'{\"type\":\"' || CASE type WHEN 'article' THEN 'article-journal' WHEN 'inproceedings' THEN 'paper-conference' ELSE 'report' END || '\",\"title\":\"' || title || '\",\"DOI\":\"' || upper(coalesce(doi, '')) || '\",\"issued\":{\"date-parts\":[[' || year || ',4]]},\"container-title\":\"' || coalesce(journal, booktitle, '') || '\"}'",
}


@query("build_pubmed", "v_files", sql="SELECT id, 'article' AS type, title, author, CAST(year AS VARCHAR) AS year, lower(doi) AS doi, journal, volume FROM v_files")
def build_pubmed(t: DataFrame) -> DataFrame:
    named = t.withColumn("names", F.expr(_NAME_LIST.format("name")))
    return providers.built(named.select("id", F.expr(_BODIES["pubmed"]).alias("body")), "pubmed").select("id", "type", "title", "author", "year", "doi", "journal", "volume")


@query("build_europepmc", "v_files", sql="SELECT id, CASE WHEN contains(lower(journal), 'journal') THEN 'article' ELSE 'misc' END AS type, title, replace(author, ',', '') AS author, CAST(year AS VARCHAR) AS year, CASE WHEN contains(lower(journal), 'journal') THEN journal END AS journal, '1-9' AS pages FROM v_files")
def build_europepmc(t: DataFrame) -> DataFrame:
    return providers.built(t.select("id", F.expr(_BODIES["europepmc"]).alias("body")), "europepmc").select("id", "type", "title", "author", "year", "journal", "pages")


@query("csl_to_entry", "v_files", sql="SELECT id, CASE WHEN type IN ('article', 'inproceedings') THEN type ELSE 'misc' END AS type, title, lower(doi) AS doi, CAST(year AS VARCHAR) AS year, CASE type WHEN 'article' THEN journal END AS journal, CASE type WHEN 'inproceedings' THEN booktitle END AS booktitle FROM v_files")
def csl_to_entry(t: DataFrame) -> DataFrame:
    return providers.built(t.select("id", F.expr(_BODIES["csl"]).alias("body")), "csl").select("id", "type", "title", "doi", "year", "journal", "booktitle")


_DAMAGED = """'{"DOI":' || CASE WHEN p_size % 5 = 1 THEN '7' ELSE '"10.1/x"' END || ',"title":' || CASE p_size % 7 WHEN 1 THEN '"x"' WHEN 2 THEN '[" "]' WHEN 3 THEN '[]' WHEN 4 THEN '[1]' ELSE '["' || p_name || '"]' END
 || ',"author":' || CASE p_size % 3 WHEN 0 THEN 'null' WHEN 1 THEN '[{"given":"A","family":' || CASE WHEN p_size % 2 = 0 THEN '5' ELSE '"B"' END || '}]' ELSE '{}' END
 || ',"issued":{"date-parts":[[' || CASE WHEN p_size % 11 = 0 THEN '"2020"' ELSE '2020' END || ']]}}'"""


@query("record_faults", "part", sql=f"""WITH b AS (SELECT p_partkey AS id, {_DAMAGED} AS j FROM part)
SELECT id, array_to_string(list_filter(['$.DOI', '$.author', '$.issued', '$.title'], lambda p: CASE p
  WHEN '$.DOI' THEN json_type(j, '$.DOI') <> 'VARCHAR'
  WHEN '$.author' THEN json_type(j, '$.author') NOT IN ('NULL', 'ARRAY') OR coalesce(json_type(j, '$.author[0].family'), 'VARCHAR') <> 'VARCHAR'
  WHEN '$.issued' THEN json_type(j, '$.issued.date-parts[0][0]') = 'VARCHAR'
  ELSE json_type(j, '$.title') <> 'ARRAY' OR coalesce(json_type(j, '$.title[0]'), '') <> 'VARCHAR' OR trim(json_extract_string(j, '$.title[0]')) = '' END), ',') AS faults FROM b""")
def record_faults(t: DataFrame) -> DataFrame:
    found = providers.faults(F.try_parse_json(F.expr(_DAMAGED)), "crossref")
    return t.select(F.col("p_partkey").alias("id"), F.array_join(found, ",").alias("faults"))


@query("json_list_decode", "v_log", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS items, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 <= 2 AS counted FROM v_log")
def json_list_decode(t: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 4
    body = F.concat(F.lit('{"count":2,"items":['), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"extra":1}'))), ","), F.lit("]}"))
    v = F.from_json(body, "count INT, items ARRAY<STRUCT<id: BIGINT>>")
    return t.select("event_id", (F.size(v["items"]) - 1).cast("long").alias("items"), (v["count"] >= F.size(v["items"]) - 1).alias("counted"))


@query("decode_dispatch", "v_log", sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'malformed' WHEN 2 THEN 'error_envelope' ELSE 'not_an_object' END AS status FROM v_log")
def decode_dispatch(t: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("{"), "props")).when(k == 2, F.lit('{"error":"quota"}')).otherwise(F.lit("[1]"))
    return t.select("event_id", F.coalesce(providers.envelope(body), F.lit("ok")).alias("status"))


@query("xml_atom_entries", "v_files", sql="SELECT id, '2301.' || lpad(CAST(id AS VARCHAR), 5, '0') AS arxiv, title, CAST(year AS VARCHAR) AS year FROM v_files WHERE id % 10 <> 0")
def xml_atom_entries(t: DataFrame) -> DataFrame:
    start = F.when(F.col("id") % 10 == 0, '<!DOCTYPE x><feed>').otherwise("<feed>")
    xml = F.concat(start, F.lit("<entry><id>http://arxiv.org/abs/2301."), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("v2</id><title>"), F.replace("title", F.lit(" "), F.lit("\n  ")),
                   F.lit("</title><published>"), F.col("year").cast("string"), F.lit("-01-01T00:00:00Z</published></entry></feed>"))
    return t.select("id", F.explode(providers.atom_entries(xml)).alias("e")).select("id", F.col("e.id").alias("arxiv"), "e.title", "e.year")


@query("parse_description", "v_files", sql="SELECT id, author AS authors, coalesce(journal, booktitle, howpublished) AS venue, CAST(year AS VARCHAR) AS year, 'x.org' AS domain FROM v_files")
def parse_description(t: DataFrame) -> DataFrame:
    c = F.concat("author", F.lit(" - "), F.coalesce("journal", "booktitle", "howpublished"), F.lit(", "), F.col("year").cast("string"), F.lit(" - x.org"))
    return t.select("id", providers.first_description(c).alias("d")).select("id", "d.*")


@query("venue_extract", "v_records", sql="SELECT seq, work_id, CASE WHEN lower(coalesce(booktitle, '')) IN ('lecture notes in computer science') THEN publisher ELSE coalesce(booktitle, journal) END AS venue FROM v_records")
def venue_extract(t: DataFrame) -> DataFrame:
    names = F.array(F.lit(""), F.coalesce("booktitle", "journal"))
    return t.select("seq", "work_id", providers.venue_of(names, F.col("publisher")).alias("venue"))


@query("entry_type", "v_files", sql="SELECT id, CASE id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' WHEN 2 THEN 'incollection' WHEN 3 THEN 'misc' ELSE CASE WHEN booktitle IS NOT NULL THEN 'inproceedings' WHEN contains(lower(coalesce(journal, '')), 'journal') THEN 'article' ELSE 'misc' END END AS type FROM v_files")
def entry_type(t: DataFrame) -> DataFrame:
    kind = F.expr("case id % 5 when 0 then 'journal-article' when 1 then 'proceedings-article' when 2 then 'book-chapter' when 3 then 'posted-content' else '' end")
    return t.select("id", providers.entry_type(kind, F.coalesce("booktitle", "journal")).alias("type"))


@query("seed_identifiers", "v_files", sql="SELECT id, CASE WHEN contains(coalesce(doi, ''), 'arxiv') THEN regexp_extract(doi, 'arxiv\\.(.*)', 1) END AS arxiv, lower(doi) AS doi FROM v_files")
def seed_identifiers(t: DataFrame) -> DataFrame:
    links = F.array(F.lit("https://example.org/x"), F.concat(F.lit("https://doi.org/"), F.col("doi")))
    long = t.select("id", F.posexplode(links).alias("k", "link"))
    found = long.select("id", "k", ids.find_arxiv("link").alias("a"), F.get(ids.find_dois("link"), F.lit(0)).alias("d"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k")))
    return found.groupBy("id").agg(first("a").alias("arxiv"), first("d").alias("doi"))


@query("prefix_reconcile", "v_files", sql="SELECT id, CASE WHEN id % 4 = 0 THEN 'author-' || id // 10 || '-' || key ELSE key END AS key FROM v_files")
def prefix_reconcile(t: DataFrame) -> DataFrame:
    had = F.when(F.col("id") % 4 == 0, F.concat(F.lit("old-9-"), "key")).otherwise(F.col("key"))
    rest = F.regexp_extract(had, r"^[a-z]+-\d+-(.*)$", 1)
    return t.select("id", F.when(rest != "", F.concat("dir", F.lit("-"), rest)).otherwise(had).alias("key"))


@query("late_doi", "v_records", sql=f"WITH a AS (SELECT work_id, list_distinct(list(lower(doi)) FILTER (source_rank < 3 AND doi IS NOT NULL)) AS found FROM v_records GROUP BY work_id) SELECT work_id, CASE len(found) WHEN 0 THEN 'none' WHEN 1 THEN 'accepted' ELSE 'conflict' END AS outcome, CASE len(found) WHEN 1 THEN found[1] END AS doi FROM (SELECT work_id, coalesce(found, []) AS found FROM a)")
def late_doi(t: DataFrame) -> DataFrame:
    found = t.groupBy("work_id").agg(F.collect_set(F.when(F.col("source_rank") < 3, ids.norm_doi("doi"))).alias("found"))
    n = F.size("found")
    return found.select("work_id", F.when(n == 0, "none").when(n == 1, "accepted").otherwise("conflict").alias("outcome"), F.when(n == 1, F.get("found", F.lit(0))).alias("doi"))


@query("stub_fill", "v_articles", sql="SELECT id, CASE id % 6 WHEN 0 THEN 'Journal of Parts' WHEN 1 THEN 'arXiv' WHEN 2 THEN 'Annals of Bolts' WHEN 3 THEN 'Proceedings of the Ring Conference' WHEN 4 THEN 'US Patent' ELSE '' END AS venue FROM v_articles")
def stub_fill(t: DataFrame) -> DataFrame:
    p = t.select("id", publication.prepared("publication").alias("s")).select("id", publication.parse(F.col("s")).alias("p"))
    return p.select("id", F.when(F.col("p.confidence") >= 0.7, F.col("p.venue")).otherwise("").alias("venue"))


@query("arxiv_normalize", "v_files", sql="SELECT id, nullif(regexp_extract(coalesce(doi, ''), '10\\.48550/arxiv\\.([0-9.]+)', 1), '') AS eprint, CASE WHEN starts_with(coalesce(doi, ''), '10.48550/arxiv') THEN 'arXiv' END AS archiveprefix FROM v_files")
def arxiv_normalize(t: DataFrame) -> DataFrame:
    eprint = F.coalesce(ids.find_arxiv("doi"), ids.find_arxiv("howpublished"))
    return t.select("id", eprint.alias("eprint"), F.when(eprint.isNotNull(), "arXiv").alias("archiveprefix"))


@query("merge_cleanup", "v_records", sql=f"SELECT seq, work_id, CASE WHEN regexp_matches(pages, '\\d') THEN pages ELSE '' END AS pages, CASE WHEN volume = year THEN '' ELSE volume END AS volume, CASE WHEN {o.is_server('journal')} THEN '' ELSE coalesce(journal, '') END AS journal FROM v_records")
def merge_cleanup(t: DataFrame) -> DataFrame:
    pages = F.regexp_replace("pages", r"\b0+(?=\d)", "")
    return t.select("seq", "work_id", F.when(pages.rlike(r"\d"), pages).otherwise("").alias("pages"), F.when(F.col("volume") == F.col("year"), "").otherwise(F.col("volume")).alias("volume"),
                    F.when(venues.is_preprint_server("journal"), "").otherwise(text.text("journal")).alias("journal"))


@query("container_enforce", "v_records", sql="SELECT seq, work_id, CASE WHEN booktitle IS NOT NULL THEN 'inproceedings' WHEN lower(journal) = 'biorxiv' THEN 'misc' ELSE 'article' END AS type FROM v_records")
def container_enforce(t: DataFrame) -> DataFrame:
    kind = F.when(F.col("booktitle").isNotNull(), "inproceedings").when(venues.is_preprint_server("journal"), "misc").when(F.col("journal").isNotNull(), "article").otherwise("misc")
    return t.select("seq", "work_id", kind.alias("type"))


ACRONYMS = {"Ai": "AI", "Iot": "IoT", "Ring": "RING"}


@query("fix_title", "v_files", sql="SELECT id, regexp_replace(replace('Ai: ' || title || ' for Iot', 'Ai', 'AI'), 'Iot', 'IoT', 'g') AS title FROM v_files")
def fix_title(t: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("Ai:"), "title", F.lit(" for Iot"))
    spaced = F.regexp_replace(raw, r":(?=\S)", ": ")
    words = F.transform(F.split(spaced, r"(?<=\b)|(?=\b)"), lambda w: F.coalesce(venues.lookup(ACRONYMS, w), w))
    return t.select("id", F.array_join(words, "").alias("title"))


@query("fix_booktitle", "v_files", sql="SELECT id, coalesce(booktitle, '') AS booktitle FROM v_files")
def fix_booktitle(t: DataFrame) -> DataFrame:
    raw = F.concat(text.text("booktitle"), F.lit(" "))
    rules = ((r"\s+", " "), (r"\s+,", ","), (r"(?i)\bIntl\.", "International"), (r"(?i)\bConf\.", "Conference"), (r",\s*$", ""))
    for pattern, by in rules:
        raw = F.regexp_replace(raw, pattern, by)
    return t.select("id", F.trim(raw).alias("booktitle"))


@query("author_casing", "v_files", sql="SELECT id, replace(replace(replace(replace(author, 'van Rossum', 'Van Rossum'), 'de la Cruz', 'DE LA Cruz'), 'O''Neil', 'O''neil'), 'Wei Li', 'Wei LI') AS author FROM v_files")
def author_casing(t: DataFrame) -> DataFrame:
    shouted = t.select("id", F.replace(F.upper("author"), F.lit(" AND "), F.lit(" And ")).alias("author"))
    return shouted.select("id", F.expr(rules.cased_author(rules.SPARK, "author")).alias("author"))


@query("author_matches", "v_files", sql="SELECT id, contains(author, 'Knuth') AS matches FROM v_files")
def author_matches(t: DataFrame) -> DataFrame:
    sigs = people.signatures(people.parse_authors("author"))
    # initials may be a subsequence: "DK" fits "DEK"
    fits = F.exists(sigs, lambda s: (s["last"] == "knuth") & ((s["initials"] == "") | F.lit("de").startswith(s["initials"]) | s["initials"].rlike("^d.*e")))
    return t.select("id", fits.alias("matches"))


@query("corpus_scan_violations", "v_files", sql="""WITH v AS (SELECT path, 'duplicate_key' AS violation FROM (SELECT path, count(*) OVER (PARTITION BY dir, key, year) AS n FROM v_files) WHERE n > 1
UNION ALL SELECT path, 'year' FROM v_files WHERE year > 2023 UNION ALL SELECT path, 'no_identifier' FROM v_files WHERE doi IS NULL AND s2_id IS NULL) SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def corpus_scan_violations(t: DataFrame) -> DataFrame:
    n = F.count("*").over(W.partitionBy("dir", "key", "year"))
    flags = t.withColumn("n", n).select(F.explode(F.filter(F.array(
        F.when(F.col("n") > 1, "duplicate_key"), F.when(F.col("year") > 2023, "year"),
        F.when(F.col("doi").isNull() & F.col("s2_id").isNull(), "no_identifier")), lambda x: x.isNotNull())).alias("violation"))
    return flags.groupBy("violation").agg(F.count("*").alias("n"))


@query("filename", "v_files", sql="SELECT id, lower(key) || year || '-' || array_to_string(string_split(regexp_replace(" + o.norm_title("title") + ", '[^a-z0-9]+', ' ', 'g'), ' ')[1:4], '-') || '.bib' AS file FROM v_files")
def filename(t: DataFrame) -> DataFrame:
    words = F.split(F.regexp_replace(text.normalize_title("title"), "[^a-z0-9]+", " "), " ")
    return t.select("id", F.concat(F.lower("key"), F.col("year").cast("string"), F.lit("-"), F.array_join(F.slice(words, 1, 4), "-"), F.lit(".bib")).alias("file"))


@query("fixpoint", "v_entries")
def fixpoint(t: DataFrame) -> DataFrame:
    """The digest of the corpus after each repetition of the load stage, until it repeats."""
    from lectern.operators import rules

    now, seen, rows = t.select("id", *rules.COLUMNS), None, []
    for turn in range(4):
        now = rules.canonicalize(now, "load_repair").select("id", *rules.COLUMNS)
        mark = str(now.agg(F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first()[0])
        rows.append((turn, mark, mark == seen))
        if mark == seen:
            break
        seen = mark
    return t.sparkSession.createDataFrame(rows, "turn long, digest string, stable boolean")


