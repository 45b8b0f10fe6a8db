"""Scalar functions and predicates as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import policy
from lectern.functions import ids, people, similarity, text, venues

from . import oracle as o
from .registry import query

HTML = "html || '<meta name=\"citation_doi\" content=\"https://doi.org/10.1145/' || CAST(page_id AS varchar(20)) || '.Ab%2F7\">'"


@query("normalize_title", "v_titles", sql=f"SELECT id, {o.norm_title('title')} AS norm_title FROM v_titles")
def normalize_title(t: DataFrame) -> DataFrame:
    return t.select("id", text.normalize_title("title").alias("norm_title"))


@query("normalize_name", "v_files", sql=f"SELECT id, {o.norm_name('author')} AS norm_name FROM v_files")
def normalize_name(t: DataFrame) -> DataFrame:
    return t.select("id", text.normalize_name("author").alias("norm_name"))


@query("strip_accents", "v_titles", sql=f"SELECT id, {o.strip_accents('title')} AS plain FROM v_titles")
def strip_accents(t: DataFrame) -> DataFrame:
    return t.select("id", text.strip_accents(F.col("title")).alias("plain"))


@query("strip_html", "pages", sql=f"""SELECT page_id, md5({o.collapse("replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')")}) AS digest FROM pages""")
def strip_html(t: DataFrame) -> DataFrame:
    return t.select("page_id", F.md5(text.strip_html(F.col("html"))).alias("digest"))


@query("placeholder", "v_records", sql=f"SELECT seq, work_id, {o.placeholder('title')} AS title_missing, {o.placeholder('volume')} AS volume_missing FROM v_records")
def placeholder(t: DataFrame) -> DataFrame:
    return t.select("seq", "work_id", text.is_placeholder("title").alias("title_missing"), text.is_placeholder("volume").alias("volume_missing"))


@query("strip_ellipsis", "v_titles", sql=r"""SELECT id, regexp_replace(regexp_replace(rtrim(title), '(?i)\s+(in|on|for|of|and|the|a|an|with|at|to|from|by)\s*$', ''), '[ ,;:]+$', '') AS cut FROM v_titles""")
def strip_ellipsis(t: DataFrame) -> DataFrame:
    return t.select("id", text.strip_ellipsis(F.concat("title", F.lit("..."))).alias("cut"))


@query("trim_title", "v_titles", sql="SELECT id, CASE WHEN id % 2 = 0 THEN replace(lower(trim(title)), 'ß', 'ss') ELSE lower(trim(title)) END AS trimmed FROM v_titles")
def trim_title(t: DataFrame) -> DataFrame:
    shown = F.when(F.col("id") % 2 == 0, F.concat(F.upper("title"), F.lit(".."))).otherwise(F.concat("title", F.lit(" *")))
    return t.select("id", F.lower(text.trim_title(shown)).alias("trimmed"))


@query("sanitize_title", "v_titles", sql="""WITH s AS (SELECT id, trim(title || ': ' || title || CASE WHEN id % 3 = 0 THEN '.' ELSE '' END) AS s FROM v_titles)
SELECT id, CASE WHEN lower(trim(split_part(s, ':', 1))) = lower(trim(string_split(s, ':')[-1])) THEN trim(split_part(s, ':', 1)) WHEN ends_with(s, '.') AND NOT ends_with(s, '..') THEN s[:-2] ELSE s END AS clean FROM s""")
def sanitize_title(t: DataFrame) -> DataFrame:
    twice = F.concat("title", F.lit(": "), "title", F.when(F.col("id") % 3 == 0, ".").otherwise(""))
    return t.select("id", text.sanitize_title(twice).alias("clean"))


@query("ascii_field", "v_titles", sql=f"SELECT id, '\"' || replace({o.latex('title')}, '&', '\\&') || ' \\& b-c\"' AS field FROM v_titles")
def ascii_field(t: DataFrame) -> DataFrame:
    return t.select("id", text.ascii_field(F.concat(F.lit("“"), "title", F.lit(" & b–c”"))).alias("field"))


@query("truncated_match", "v_pairs", sql=f"""WITH n AS (SELECT lid, rid, {o.norm_title('ltitle')} AS a, {o.norm_title('rtitle')} AS b FROM v_pairs)
SELECT lid, rid, a <> b AND least(len(a), len(b)) >= 15 AND CASE WHEN len(a) <= len(b) THEN starts_with(b, a) OR ends_with(b, a) ELSE starts_with(a, b) OR ends_with(a, b) END AS truncated FROM n""")
def truncated_match(t: DataFrame) -> DataFrame:
    return t.select("lid", "rid", text.truncated_match(text.normalize_title("ltitle"), text.normalize_title("rtitle")).alias("truncated"))


@query("title_similarity", "v_pairs", sql=f"""WITH n AS (SELECT lid, rid, {o.norm_title('ltitle')} AS a, {o.norm_title('rtitle')} AS b FROM v_pairs)
SELECT lid, rid, round({o.ratio('a', 'b')}, 6) AS similarity FROM n""")
def title_similarity(t: DataFrame) -> DataFrame:
    return t.select("lid", "rid", F.round(similarity.indel_ratio(text.normalize_title("ltitle"), text.normalize_title("rtitle")), 6).alias("similarity"))


@query("venue_similarity", "v_pairs", sql=f"""WITH n AS (SELECT lid, rid, {o.norm_title('lvenue')} AS a, {o.norm_title('rvenue')} AS b, trim(coalesce(lvenue, '')) AS x, trim(coalesce(rvenue, '')) AS y FROM v_pairs)
SELECT lid, rid, CASE WHEN x = '' OR y = '' THEN 0.0 ELSE round({o.ratio('a', 'b')}, 6) END::DOUBLE AS similarity FROM n""")
def venue_similarity(t: DataFrame) -> DataFrame:
    score = F.round(similarity.indel_ratio(text.normalize_title("lvenue"), text.normalize_title("rvenue")), 6)
    empty = (F.trim(text.text("lvenue")) == "") | (F.trim(text.text("rvenue")) == "")
    return t.select("lid", "rid", F.when(empty, 0.0).otherwise(score).alias("similarity"))


@query("name_signature", "v_files", sql=f"""SELECT id, n AS name, {o.signature('n')}.last AS last, {o.signature('n')}.initials AS initials FROM (SELECT id, unnest(string_split(author, ' and ')) AS n FROM v_files)""")
def name_signature(t: DataFrame) -> DataFrame:
    names = t.select("id", F.explode(people.parse_authors("author")).alias("name"))
    return names.withColumn("s", people.signature(F.col("name"))).select("id", "name", "s.last", "s.initials")


_SIGS = f"SELECT lid, rid, {o.signatures('lauthor')} AS a, {o.signatures('rauthor')} AS b FROM v_pairs"


@query("authors_overlap", "v_pairs", sql=f"""WITH n AS ({_SIGS}), x AS (SELECT lid, rid, unnest(a) AS p, b FROM n), y AS (SELECT lid, rid, p, unnest(b) AS q FROM x)
SELECT lid, rid, bool_or(p.last = q.last AND {o.compatible('p.initials', 'q.initials')}) AS overlap FROM y GROUP BY lid, rid""")
def authors_overlap(t: DataFrame) -> DataFrame:
    a, b = (people.signatures(people.parse_authors(c)) for c in ("lauthor", "rauthor"))
    return t.select("lid", "rid", people.overlap(a, b).alias("overlap"))


@query("author_jaccard", "v_pairs", sql=f"""WITH n AS ({_SIGS}), m AS (SELECT lid, rid, len(a) AS na, len(b) AS nb, len(list_filter(a, lambda p: len(list_filter(b, lambda q: p.last = q.last AND {o.compatible('p.initials', 'q.initials')})) > 0)) AS hits FROM n)
SELECT lid, rid, round(hits::DOUBLE / (na + nb - hits), 6) AS ratio FROM m""")
def author_jaccard(t: DataFrame) -> DataFrame:
    a, b = (people.signatures(people.parse_authors(c)) for c in ("lauthor", "rauthor"))
    return t.select("lid", "rid", F.round(people.overlap_ratio(a, b), 6).alias("ratio"))


@query("parse_authors", "v_files", sql="SELECT id, unnest(string_split(author, ' and ')) AS name FROM v_files")
def parse_authors(t: DataFrame) -> DataFrame:
    return t.select("id", F.explode(people.parse_authors(F.concat("author", F.lit(" and others")))).alias("name"))


@query("last_name", "v_files", sql="""SELECT id, CASE WHEN contains(n, ',') THEN split_part(n, ',', 1) ELSE string_split(n, ' ')[-1] END AS last FROM (SELECT id, split_part(author, ' and ', 1) AS n FROM v_files)""")
def last_name(t: DataFrame) -> DataFrame:
    return t.select("id", people.last_name(F.get(people.parse_authors("author"), F.lit(0))).alias("last"))


@query("author_list_form", "v_files", sql="""SELECT id, len(list_filter(string_split(author, ' and '), lambda n: regexp_full_match(n, '\\S+ [A-Z]{1,4}'))) * 2 >= len(string_split(author, ' and ')) AS surname_initials FROM v_files""")
def author_list_form(t: DataFrame) -> DataFrame:
    names = people.parse_authors("author")
    return t.select("id", (F.size(F.filter(names, lambda n: n.rlike(r"^\S+ [A-Z]{1,4}$"))) * 2 >= F.size(names)).alias("surname_initials"))


@query("norm_doi", "v_files", sql="SELECT id, lower(doi) || '/a+b' AS doi FROM v_files WHERE doi IS NOT NULL UNION ALL SELECT id, NULL FROM v_files WHERE doi IS NULL")
def norm_doi(t: DataFrame) -> DataFrame:
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" https://DX.doi.org/"), F.upper("doi"), F.lit("%2Fa+b "))).otherwise(F.concat(F.lit("doi: "), "doi", F.lit("/A+b")))
    return t.select("id", ids.norm_doi(raw).alias("doi"))


@query("find_dois", "v_files", sql="""SELECT id, coalesce(lower(regexp_extract(doi, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+')), '') || '|10.1000/x' || id AS found FROM v_files""")
def find_dois(t: DataFrame) -> DataFrame:
    body = F.concat(F.lit("see ("), text.text("doi"), F.lit(") and 10.1000/X"), F.col("id").cast("string"), F.lit(", again 10.1000/x"), F.col("id").cast("string"))
    found = ids.find_dois(body)
    return t.select("id", F.when(F.size(found) == 1, F.concat(F.lit("|"), F.get(found, F.lit(0)))).otherwise(F.array_join(found, "|")).alias("found"))


@query("html_doi", "pages", sql="SELECT page_id, '10.1145/' || page_id || '.ab/7' AS doi FROM pages")
def html_doi(t: DataFrame) -> DataFrame:
    return t.select("page_id", ids.html_doi(F.expr(HTML)).alias("doi"))


@query("doi_base_join", "v_files", sql="""WITH b AS (SELECT id, doi, regexp_replace(lower(doi), '\\.v\\d+$', '') AS base FROM v_files WHERE doi IS NOT NULL)
SELECT l.id AS lid, r.id AS rid, l.base FROM b l JOIN b r ON l.base = r.base AND l.id < r.id AND l.doi <> r.doi""")
def doi_base_join(t: DataFrame) -> DataFrame:
    b = t.where("doi is not null").select("id", "doi", ids.doi_base(F.col("doi")).alias("base"))
    return b.alias("l").join(b.alias("r"), "base").where("l.id < r.id and l.doi <> r.doi").select(F.col("l.id").alias("lid"), F.col("r.id").alias("rid"), "base")


@query("is_secondary_doi", "v_files", sql=f"SELECT id, {o.is_secondary('doi')} AS secondary, {o.is_preprint_doi('doi')} AS preprint FROM v_files")
def is_secondary_doi(t: DataFrame) -> DataFrame:
    return t.select("id", ids.is_secondary_doi(F.col("doi")).alias("secondary"), ids.is_preprint_doi(F.col("doi")).alias("preprint"))


@query("is_preprint", "v_files", sql=f"SELECT id, {o.is_preprint_doi('doi')} OR {o.is_server('journal')} AS preprint FROM v_files")
def is_preprint(t: DataFrame) -> DataFrame:
    return t.select("id", venues.is_preprint_record(F.col("doi"), F.col("journal")).alias("preprint"))


@query("arxiv_id", "v_articles", sql="""WITH a AS (SELECT id, regexp_extract(publication, 'arXiv:(\\d{4}\\.\\d{5})', 1) AS x FROM v_articles) SELECT id, CASE WHEN x <> '' THEN x END AS found, CASE WHEN x <> '' AND substr(x, 6)::INT > 0 THEN x END AS strict FROM a""")
def arxiv_id(t: DataFrame) -> DataFrame:
    found = ids.find_arxiv("publication")
    return t.select("id", found.alias("found"), ids.strict_arxiv(F.concat(F.lit("arXiv: "), found, F.lit("v3"))).alias("strict"))


@query("url_allowlist", "pages", sql="""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://doi.org/10.1/' || page_id WHEN 1 THEN 'https://arxiv.org/abs/2301.' || page_id END AS url FROM pages""")
def url_allowlist(t: DataFrame) -> DataFrame:
    raw = F.expr("case page_id % 3 when 0 then ' http://dx.doi.org/10.1/' || page_id when 1 then 'http://arxiv.org/abs/2301.' || page_id else url end")
    return t.select("page_id", ids.allowed_url(raw).alias("url"))


@query("redact_url", "pages", sql="SELECT page_id, url || '&api_key=***&token=***' AS url FROM pages")
def redact_url(t: DataFrame) -> DataFrame:
    raw = F.concat("url", F.lit("&api_key=S3cret&token=abc"))
    return t.select("page_id", F.regexp_replace(raw, r"(?i)([?&](?:access_token|api_key|apikey|api-key|token|key)=)[^&#]*", "$1***").alias("url"))


@query("url_identity", "pages", sql="""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)
SELECT page_id, sha256(lower(regexp_extract(u, '^(https?://[^/?]*)', 1)) || regexp_extract(u, '^https?://[^/?]*([^?]*)', 1) || '?' || coalesce(array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(u, '?') THEN regexp_extract(u, '\\?(.*)$', 1) ELSE '' END, '&'), lambda x: x <> '')), '&'), '')) AS identity FROM p""")
def url_identity(t: DataFrame) -> DataFrame:
    u = F.substring_index("url", "#", 1)
    args = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: x != ""))
    return t.select("page_id", F.sha2(F.concat(F.lower(F.regexp_extract(u, r"^(https?://[^/?]*)", 1)), F.regexp_extract(u, r"^https?://[^/?]*([^?]*)", 1), F.lit("?"), F.array_join(args, "&")), 256).alias("identity"))


@query("cache_key", "v_titles", sql=f"SELECT id, sha256('s2' || chr(0) || {o.norm_title('title')}) AS key FROM v_titles")
def cache_key(t: DataFrame) -> DataFrame:
    return t.select("id", F.sha2(F.concat(F.lit("s2\0"), text.normalize_title("title")), 256).alias("key"))


@query("extract_year", "orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::INT WHEN o_orderkey % 3 = 1 THEN year(o_orderdate)::INT ELSE 0 END AS year FROM orders")
def extract_year(t: DataFrame) -> DataFrame:
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k == 1, F.concat(F.lit("c. "), F.year("o_orderdate").cast("string"), F.lit("0"))).otherwise("n.d.")
    return t.select("o_orderkey", F.coalesce(ids.year_of(raw), F.lit(0)).alias("year"))


@query("howpublished", "v_files", sql="SELECT id, CASE WHEN starts_with(lower(coalesce(doi, '')), '10.48550/arxiv') THEN 'arXiv' END AS howpublished FROM v_files")
def howpublished(t: DataFrame) -> DataFrame:
    return t.select("id", venues.howpublished_of("doi").alias("howpublished"))


@query("conference_journal", "v_files", sql="SELECT id, coalesce(contains(lower(booktitle), 'proceedings'), false) AS conference FROM v_files")
def conference_journal(t: DataFrame) -> DataFrame:
    return t.select("id", venues.is_conference_journal(F.coalesce("booktitle", "journal", "howpublished")).alias("conference"))


@query("backoff", "v_log", sql="SELECT event_id, least(greatest(value, 0), 16)::DOUBLE AS retry_after, least(pow(2, event_id % 7), 16)::DOUBLE AS wait FROM v_log")
def backoff(t: DataFrame) -> DataFrame:
    return t.select("event_id", F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(16.0)).alias("retry_after"),
                    F.least(F.pow(F.lit(2.0), F.col("event_id") % 7), F.lit(16.0)).alias("wait"))


_STATUS = "CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 408 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN 404 WHEN 7 THEN 302 ELSE 204 END"


@query("classify_outcome", "v_log", sql=f"""SELECT event_id, s AS status, CASE WHEN s IN (401, 403) THEN 'auth_failed' WHEN s IN (408, 425, 429) OR s >= 500 THEN 'retry_wait' WHEN s BETWEEN 400 AND 499 THEN 'permanent' WHEN s BETWEEN 300 AND 399 THEN 'redirect' WHEN s = 204 THEN 'empty' ELSE 'success' END AS outcome FROM (SELECT event_id, ({_STATUS})::INT AS s FROM v_log)""")
def classify_outcome(t: DataFrame) -> DataFrame:
    s = F.col("status")
    return t.select("event_id", F.expr(_STATUS).alias("status")).withColumn(
        "outcome", F.when(s.isin(401, 403), "auth_failed").when(s.isin(408, 425, 429) | (s >= 500), "retry_wait")
        .when(s >= 400, "permanent").when(s >= 300, "redirect").when(s == 204, "empty").otherwise("success"))


@query("title_filter", "v_titles", sql="SELECT id, len(regexp_extract_all(title, '\\S+')) >= 2 AND NOT regexp_matches(title, '\\S+@\\S+\\.\\S+') AND NOT regexp_matches(title, '(?i)^(proceedings|correction)') AS valid FROM v_titles")
def title_filter(t: DataFrame) -> DataFrame:
    c = F.col("title")
    return t.select("id", ((F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0)) >= 2) & ~c.rlike(r"\S+@\S+\.\S+") & ~c.rlike("(?i)^(proceedings|correction)")).alias("valid"))


@query("privacy_flags", "documents", sql="SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS contact, regexp_matches(text, '(?i)(password|secret|api[_-]?key|token)\\s*[:=]\\s*\\S+') AS secret, regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS control FROM documents")
def privacy_flags(t: DataFrame) -> DataFrame:
    c = F.col("text")
    return t.select("doc_id", c.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("contact"),
                    c.rlike(r"(?i)(password|secret|api[_-]?key|token)\s*[:=]\s*\S+").alias("secret"), c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]").alias("control"))


@query("id_validity", "v_census", sql="SELECT row_no, regexp_full_match(regexp_extract(scholar, 'user=([^&]*)', 1), '[A-Za-z0-9_-]{12}') AS scholar_ok, dblp <> '' AS dblp_ok FROM v_census")
def id_validity(t: DataFrame) -> DataFrame:
    return t.select("row_no", F.regexp_extract("scholar", "user=([^&]*)", 1).rlike("^[A-Za-z0-9_-]{12}$").alias("scholar_ok"),
                    F.regexp_extract("dblp", r"/pid/([0-9a-z]+/[0-9A-Za-z-]+)$", 1).rlike(".+").alias("dblp_ok"))


@query("pages_valid", "v_records", sql="SELECT seq, work_id, regexp_matches(pages, '\\d') AS valid FROM v_records")
def pages_valid(t: DataFrame) -> DataFrame:
    long_ = F.exists(F.split("pages", "[-–,]+"), lambda p: F.length(F.regexp_replace(p, r"\D", "")) > 8)
    return t.select("seq", "work_id", (F.col("pages").rlike(r"\d") & ~long_).alias("valid"))


@query("json_envelope", "v_log", sql="SELECT event_id, json_extract_string(props, '$.k')::INT AS k, true AS valid FROM v_log")
def json_envelope(t: DataFrame) -> DataFrame:
    parsed = F.from_json("props", "k INT, error STRING")
    return t.select("event_id", parsed["k"].alias("k"), (parsed.isNotNull() & parsed["error"].isNull() & F.col("props").rlike(r"^\s*\{")).alias("valid"))


@query("json_to_text", "v_log", sql="SELECT event_id, json_extract_string(props, '$.k') AS shown FROM v_log")
def json_to_text(t: DataFrame) -> DataFrame:
    return t.select("event_id", F.coalesce(F.variant_get(F.parse_json("props"), "$.k", "string"), F.lit("")).alias("shown"))


@query("author_dirname", "v_census", sql="SELECT row_no, regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || CASE WHEN scholar <> '' THEN ' (' || regexp_extract(scholar, 'user=(.*)', 1) || ')' ELSE '' END AS dir FROM v_census")
def author_dirname(t: DataFrame) -> DataFrame:
    base = F.regexp_replace(F.regexp_replace("name", "[^A-Za-z0-9]+", "-"), "^-|-$", "")
    user = F.regexp_extract("scholar", "user=(.*)", 1)
    return t.select("row_no", F.concat(base, F.when(user != "", F.concat(F.lit(" ("), user, F.lit(")"))).otherwise("")).alias("dir"))


@query("parse_publication", "v_articles", sql="""SELECT id,
 CASE id % 6 WHEN 0 THEN 'Journal of Parts' WHEN 1 THEN 'arXiv' WHEN 2 THEN 'Annals of Bolts' WHEN 3 THEN 'Proceedings of the Ring Conference' WHEN 4 THEN 'US Patent' ELSE 'Sage' END AS venue,
 CASE id % 6 WHEN 0 THEN 'journal' WHEN 1 THEN 'preprint' WHEN 2 THEN 'journal' WHEN 3 THEN 'conference' WHEN 4 THEN 'patent' ELSE 'publisher' END AS venue_type,
 CASE WHEN id % 6 IN (0, 2) THEN (id % 60)::VARCHAR ELSE '' END AS volume, CASE WHEN id % 6 = 0 THEN (id % 12)::VARCHAR ELSE '' END AS issue,
 CASE id % 6 WHEN 0 THEN (id % 300) || '-' || (id % 300 + 9) WHEN 2 THEN '1-9' WHEN 3 THEN '5-8' ELSE '' END AS pages, year,
 CASE id % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 WHEN 4 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM v_articles""")
def parse_publication(t: DataFrame) -> DataFrame:
    from lectern.functions.publication import parse, prepared

    return t.select("id", prepared("publication").alias("s")).select("id", parse(F.col("s")).alias("p")).select("id", "p.*")
