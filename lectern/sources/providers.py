"""Decoders of recorded provider responses: JSON by schema and by declared paths, Atom XML, and projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import policy
from lectern.functions.ids import DOI, blank_to_null, norm_doi
from lectern.functions.text import any_of, text

# provider -> target field -> paths in order; the first that is not empty wins
MAPPINGS = {
    "crossref": {
        "title": ("$.title[0]",), "year": ("$.issued.date-parts[0][0]", "$.published-print.date-parts[0][0]", "$.created.year"), "doi": ("$.DOI",),
        "venue": ("$.container-title[0]", "$.event.name"), "kind": ("$.type",), "volume": ("$.volume",), "number": ("$.issue",), "pages": ("$.page",), "publisher": ("$.publisher",),
    },
    "openalex": {
        "title": ("$.display_name", "$.title"), "year": ("$.publication_year",), "doi": ("$.doi",), "venue": ("$.primary_location.source.display_name",),
        "kind": ("$.type",), "volume": ("$.biblio.volume",), "number": ("$.biblio.issue",), "pages": ("$.biblio.first_page",),
    },
    "s2": {
        "title": ("$.title",), "year": ("$.year",), "doi": ("$.externalIds.DOI",), "venue": ("$.venue", "$.journal.name"),
        "kind": ("$.publicationTypes[0]",), "volume": ("$.journal.volume",), "pages": ("$.journal.pages",),
    },
    "pubmed": {
        "title": ("$.title",), "year": ("$.pubdate",), "doi": ("$.doi", "$.elocationid"), "venue": ("$.fulljournalname", "$.source"),
        "kind": ("$.pubtype[0]",), "volume": ("$.volume",), "number": ("$.issue",), "pages": ("$.pages",),
    },
    "europepmc": {
        "title": ("$.title",), "year": ("$.pubYear",), "doi": ("$.doi",), "venue": ("$.journalTitle", "$.journalInfo.journal.title"),
        "kind": ("$.pubType",), "volume": ("$.journalVolume", "$.journalInfo.volume"), "number": ("$.issue",), "pages": ("$.pageInfo",),
    },
    "csl": {
        "title": ("$.title", "$.title[0]"), "year": ("$.issued.date-parts[0][0]",), "doi": ("$.DOI",), "venue": ("$.container-title", "$.container-title[0]", "$.event"),
        "kind": ("$.type",), "volume": ("$.volume",), "number": ("$.issue",), "pages": ("$.page",), "publisher": ("$.publisher",),
    },
}

# provider -> (path, type of the author list, name from one of its members); a type of STRING is one string parted by ", "
AUTHORS = {
    "crossref": ("$.author", "ARRAY<STRUCT<given: STRING, family: STRING>>", lambda a: F.concat_ws(" ", a["given"], a["family"])),
    "csl": ("$.author", "ARRAY<STRUCT<given: STRING, family: STRING>>", lambda a: F.concat_ws(" ", a["given"], a["family"])),
    "openalex": ("$.authorships", "ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>", lambda a: a["author"]["display_name"]),
    "s2": ("$.authors", "ARRAY<STRUCT<name: STRING>>", lambda a: a["name"]),
    "pubmed": ("$.authors", "ARRAY<STRUCT<name: STRING>>", lambda a: a["name"]),
    "europepmc": ("$.authorString", "STRING", None),
}

# provider -> (path, pattern of the type that a member may have where it is there, whether null may stand for it)
_TEXT, _WHOLE, _TEXTS = "STRING", "BIGINT", "ARRAY<(STRING|VOID)>"
_DATES = "OBJECT<.*ARRAY<ARRAY<(BIGINT|VOID)>>.*>"
_ONLY = lambda names, kind="STRING": f"(?!.*\\b({names}): (?!{kind}))"
MEMBERS = {
    "crossref": [
        *((f"$.{k}", _TEXT, False) for k in ("DOI", "publisher", "type", "URL", "volume", "issue", "page")), ("$.container-title", _TEXTS, False),
        *((f"$.{k}", _DATES, False) for k in ("issued", "published-print", "published-online")),
        ("$.author", _ONLY("given|family") + "ARRAY<(VOID|OBJECT<.*>)>", True),
    ],
    "s2": [
        ("$.authors", _ONLY("name") + "ARRAY<(VOID|OBJECT<.*\\bname: STRING.*>)>", True), ("$.publicationTypes", _TEXTS, True),
        ("$.externalIds", "OBJECT<([^:]+: STRING)?>", True), ("$.journal", _ONLY("name|volume|pages") + "OBJECT<.*>", True),
        *((f"$.{k}", _TEXT, False) for k in ("venue", "url", "abstract", "publicationDate")), *((f"$.{k}", _WHOLE, False) for k in ("year", "citationCount")),
    ],
    "openalex": [
        ("$.authorships", _ONLY("display_name") + "ARRAY<(VOID|OBJECT<.*\\bauthor: OBJECT<.*\\bdisplay_name: STRING.*>.*>)>", True),
        *((f"$.{k}", _TEXT, False) for k in ("doi", "type")), ("$.publication_year", _WHOLE, False), ("$.primary_location", "OBJECT<.*>", True),
        ("$.primary_location.source", "OBJECT<.*\\bdisplay_name: STRING.*>", True),
    ],
    "europepmc": [(f"$.{k}", _TEXT, False) for k in ("title", "authorString", "pubYear", "doi", "journalTitle", "journalVolume", "issue", "pageInfo")],
    "csl": [*((f"$.{k}", _TEXT, False) for k in ("type", "DOI", "URL", "volume", "issue", "page", "publisher")), ("$.title", "STRING|ARRAY<STRING>", False)],
}
REQUIRED = {"crossref": "ARRAY<STRING>", "csl": "STRING|ARRAY<STRING>"}


def faults(payload: Column, provider: str) -> Column:
    """Paths of a record's members, over a VARIANT, that are not of their type, a missing title among them. Types are
    read from the value itself, so that no number passes for a text; nothing is cast."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(payload, _path(p), "variant"))
    out = []
    for path, pattern, nullable in MEMBERS[provider]:
        fine = kind(path).rlike(f"^({pattern})$") | (kind(path) == "VOID" if nullable else F.lit(False))
        if path == "$.externalIds":  # a map: any names, all texts
            fine = fine | kind(path).rlike("^OBJECT<([^:<>]+: STRING, )*[^:<>]+: STRING>$")
        out.append(F.when(kind(path).isNotNull() & ~fine, F.lit(path)))
    if provider in REQUIRED:
        one, many = F.try_variant_get(payload, "$.title", "string"), F.try_variant_get(payload, "$.title", "array<string>")
        blank = F.coalesce(F.exists(many, lambda x: F.trim(x) == ""), F.trim(one) == "", F.lit(True))
        out.append(F.when(~F.coalesce(kind("$.title").rlike(f"^({REQUIRED[provider]})$"), F.lit(False)) | blank, F.lit("$.title")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))


def authors_of(payload: Column, provider: str) -> Column:
    """The names of a record's authors, parted by " and "."""
    path, kind, name = AUTHORS[provider]
    found = F.try_variant_get(payload, _path(path), kind)
    if name is None:
        return F.replace(F.regexp_replace(F.coalesce(found, F.lit("")), r"[.]\s*$", ""), F.lit(", "), F.lit(" and "))
    return F.array_join(F.filter(F.transform(F.coalesce(found, F.array().cast(kind)), name), lambda x: F.trim(x) != ""), " and ")


def built(responses: DataFrame, provider: str) -> DataFrame:
    """Recorded responses (id, body) as entries: type, title, author, year, doi, journal or booktitle by type, volume,
    number, pages, publisher. The year is the first of its field; a DOI may stand in a longer text."""
    held = responses.withColumn("v", F.try_parse_json("body"))
    rows = held.select("id", authors_of(F.col("v"), provider).alias("author"), *project(F.col("v"), provider))
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    kind = entry_type(have("kind"), F.col("venue"))
    in_book = kind.isin("inproceedings", "incollection")
    return rows.select(
        "id", kind.alias("type"), "title", "author", F.regexp_extract("year", r"(19|20)\d{2}", 0).alias("year"),
        F.coalesce(blank_to_null(F.lower(F.regexp_extract(F.coalesce("doi", F.lit("")), DOI, 1))), F.when(F.startswith("doi", F.lit("10.")), F.col("doi"))).alias("doi"),
        F.when(kind == "article", F.col("venue")).alias("journal"), F.when(in_book, F.col("venue")).alias("booktitle"),
        *[have(c).alias(c) for c in ("volume", "number", "pages", "publisher")],
    )


def project(payload: Column, provider: str, targets: tuple[str, ...] = ()) -> list[Column]:
    """Columns of one provider's mapping over a VARIANT."""
    out = []
    for target, paths in MAPPINGS[provider].items():
        if targets and target not in targets:
            continue
        value = F.coalesce(*[blank_to_null(F.trim(F.try_variant_get(payload, _path(p), "string"))) for p in paths])
        out.append((norm_doi(value) if target == "doi" else value).alias(target))
    return out


def _path(p: str) -> str:
    """The path with every name in brackets: names may hold hyphens."""
    return "$" + re.sub(r"\.([A-Za-z][\w-]*)", r"['\1']", p[1:])


def envelope(body: Column) -> Column:
    """What is wrong with a JSON body: not JSON, not an object, an error envelope; else null."""
    v = F.try_parse_json(body)
    return F.when(v.isNull(), "malformed").when(~F.trim(body).startswith("{"), "not_an_object").when(
        F.try_variant_get(v, "$.error", "string").isNotNull(), "error_envelope"
    )


def atom_entries(xml: Column) -> Column:
    """Array of (id, title, year) of an Atom feed; null where a document type or entity is declared."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), 1)
    safe = ~xml.rlike("(?i)<!(DOCTYPE|ENTITY)")
    return F.when(safe, F.transform(entries, lambda e: F.struct(
        F.regexp_extract(e, r"<id>[^<]*/abs/([^<v]*)(?:v\d+)?</id>", 1).alias("id"),
        F.trim(F.regexp_replace(F.regexp_extract(e, r"(?s)<title>(.*?)</title>", 1), r"\s+", " ")).alias("title"),
        F.regexp_extract(e, r"<published>(\d{4})", 1).alias("year"),
    )))


def venue_of(names: Column, event: Column) -> Column:
    """The first name that is neither empty nor a generic series, else the event, else the first name."""
    named = F.filter(names, lambda x: (F.trim(x) != "") & ~F.lower(F.trim(x)).isin(*policy.GENERIC_SERIES))
    return F.coalesce(F.get(named, F.lit(0)), blank_to_null(event), F.get(names, F.lit(0)))


def entry_type(kind: Column, venue: Column) -> Column:
    """Entry type from a provider's type string, else from hints in the venue."""
    k, v = F.lower(text(kind)), F.lower(text(venue))
    return (
        F.when(any_of(k, ("journal-article", "journalarticle", "article-journal", "journal article")), "article").when(any_of(k, ("proceedings", "conference")), "inproceedings")
        .when(any_of(k, ("book-chapter", "chapter")), "incollection").when(any_of(k, ("dissertation", "thesis")), "phdthesis")
        .when(any_of(k, ("posted-content", "preprint")), "misc").when(any_of(v, policy.CONFERENCE_WORDS), "inproceedings")
        .when(any_of(v, ("journal", "transactions", "letters")), "article").otherwise("misc")
    )


def first_description(c: Column) -> Column:
    """Struct (authors, venue, year, domain) of "authors - venue, year - domain"."""
    parts = F.split(c, " - ")
    middle = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.struct(
        F.get(parts, F.lit(0)).alias("authors"), F.trim(F.regexp_replace(middle, r",?\s*(19|20)\d{2}\s*$", "")).alias("venue"),
        F.regexp_extract(middle, r"((19|20)\d{2})\s*$", 1).alias("year"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("domain"),
    )


def replay(responses: DataFrame, provider: str) -> DataFrame:
    """Recorded responses (id, body) as canonical records of one provider."""
    return responses.withColumn("v", F.try_parse_json("body")).select("id", *project(F.col("v"), provider, ("title", "year", "doi", "venue")))
