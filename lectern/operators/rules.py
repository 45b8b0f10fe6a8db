"""The canonicaliser: ordered, guarded rewrites of entries, a rule table that two SQL dialects can run.

A rule is (guard, {column: new value}); all its values are read before any is written. A stage applies
its rules in order, a projection for each, so that Catalyst sees plain CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import policy

COLUMNS = ("type", "title", "author", "journal", "booktitle", "howpublished", "doi", "url", "volume", "pages", "publisher", "school", "note", "eprint")


@dataclass(frozen=True)
class Dialect:
    """How a dialect spells what the rules need; patterns have no look-around."""

    name: str

    def replace(self, c: str, pattern: str, by: str) -> str:
        if self.name == "spark":
            return f"regexp_replace({c}, r'{pattern}', '{by.replace(chr(92) + '1', '$1')}')"
        return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"

    def like(self, c: str, pattern: str) -> str:
        return f"regexp_like({c}, r'{pattern}')" if self.name == "spark" else f"regexp_matches({c}, '{pattern}')"

    def group(self, c: str, pattern: str) -> str:
        return f"regexp_extract({c}, r'{pattern}', 1)" if self.name == "spark" else f"regexp_extract({c}, '{pattern}', 1)"

    def starts(self, c: str, prefix: str) -> str:
        return f"{'startswith' if self.name == 'spark' else 'starts_with'}({c}, '{prefix}')"

    def any_start(self, c: str, prefixes) -> str:
        return "(" + " OR ".join(self.starts(c, p) for p in prefixes) + ")"

    def any_in(self, c: str, parts) -> str:
        return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"

    def table(self, c: str, pairs, other: str) -> str:
        return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + f" ELSE {other} END"


    def words(self, c: str, by: str = " ") -> str:
        return f"{'split' if self.name == 'spark' else 'string_split'}({c}, '{by}')"

    def each(self, items: str, var: str, body: str) -> str:
        return f"transform({items}, {var} -> {body})" if self.name == "spark" else f"list_transform({items}, lambda {var}: {body})"

    def every(self, items: str, var: str, test: str) -> str:
        if self.name == "spark":
            return f"forall({items}, {var} -> {test})"
        return f"len(list_filter({items}, lambda {var}: NOT ({test}))) = 0"

    def joined(self, items: str, by: str) -> str:
        return f"{'array_join' if self.name == 'spark' else 'array_to_string'}({items}, '{by}')"

    def end(self, items: str, at: int) -> str:
        return f"element_at({items}, {at})" if self.name == "spark" else f"({items})[{at}]"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def _capital(w: str) -> str:
    return f"(upper(substring({w}, 1, 1)) || lower(substring({w}, 2)))"


def trimmed_title(d: Dialect, c: str) -> str:
    """A title without artefacts before it and up to two dots or stars after it; one in capitals gets title case."""
    s = f"trim({d.replace(f'trim({c})', '^Check for [uU]pdates ', '')})"
    bare = d.replace(f"rtrim({d.replace(s, '[*]+$', '')})", "([^.])[.][.]?$", r"\1")
    kept = f"CASE WHEN {d.like(s, '([.][.][.]|…)$')} THEN {s} ELSE rtrim({bare}) END"
    parts = d.joined(d.each(d.words("w", "-"), "p", f"CASE WHEN length(p) > 1 THEN {_capital('p')} ELSE p END"), "-")
    small = ", ".join(f"'{w}'" for w in policy.SMALL_WORDS)
    word = (f"CASE WHEN contains(w, '-') THEN {parts} WHEN {d.like('w', '^[(]|^\\[')} THEN substring(w, 1, 1) || {_capital('substring(w, 2)')}"
            f" WHEN lower(w) IN ({small}) THEN lower(w) ELSE {_capital('w')} END")
    cased = d.joined(d.each(d.words(d.replace(kept, r"\s+", " ")), "w", word), " ")
    letters, capitals = (f"length({d.replace(kept, f'[^{k}]', '')})" for k in ("A-Za-z", "A-Z"))
    return f"CASE WHEN {capitals} > 0.6 * {letters} THEN upper(substring({cased}, 1, 1)) || substring({cased}, 2) ELSE {kept} END"


def fixed_title(d: Dialect, c: str) -> str:
    """A title with fused compounds parted, blanks around colons and hyphens mended, and acronyms in their case."""
    out = c
    for suffix in policy.COMPOUND_SUFFIXES:
        out = d.replace(out, rf"\b([A-Z][a-z][a-z][a-z]+){suffix}\b", rf"\1-{suffix.capitalize()}")
    out = d.replace(out, r"([^\s]):([A-Z])", r"\1: \2" if d.name != "spark" else "$1: $2")
    for word in ("and", "or", "to"):  # "pre- and post-" keeps its blank
        out = f"replace({out}, '- {word} ', '-' || chr(1) || '{word} ')"
    out = d.replace(out, r"(\w)- ", r"\1-")
    out = d.replace(f"replace({out}, chr(1), ' ')", r"(\w) -(\w)", r"\1-\2" if d.name != "spark" else "$1-$2")
    for wrong, right in policy.ACRONYM_CASE.items():
        out = d.replace(out, rf"\b{wrong}\b", right)
    return out


def cased_author(d: Dialect, c: str) -> str:
    """Names in capitals or lower case with capitals at their start; initials stay where the whole list has them."""
    names = d.words(f"replace(replace({c}, ' and And ', ' and '), ' And ', ' and ')", " and ")
    tokens = lambda n: d.words(d.replace(f"trim({n})", r"\s+", " "))
    last, first = (lambda n: d.end(tokens(n), -1)), (lambda n: d.end(tokens(n), 1))
    capitals = lambda w: f"({w} = upper({w}) AND {w} <> lower({w}))"
    mixed = f"NOT ({d.every(tokens('n'), 'x', f'NOT ({d.like('x', '^[A-Z][A-Za-z]+$')} AND x <> upper(x))')})"
    trailing, leading = d.every(names, "m", d.like(last("m"), "^[A-Z][A-Z]?$")), d.every(names, "m", d.like(first("m"), "^[A-Z][A-Z]?[A-Z]?$"))
    token = (f"CASE WHEN {d.like('w', '^[^A-Za-zÀ-ÿ]')} OR w = '' THEN w WHEN ({trailing}) AND w = {last('n')} THEN w WHEN ({leading}) AND w = {first('n')} THEN w"
             f" WHEN length(w) > 2 AND {capitals('w')} OR length(w) = 2 AND {capitals('w')} AND w = {last('n')} AND {mixed}"
             f" OR length(w) > 1 AND substring(w, 1, 1) = lower(substring(w, 1, 1)) THEN {_capital('w')} ELSE w END")
    one = f"CASE WHEN contains(trim(n), ' ') THEN {d.joined(d.each(tokens('n'), 'w', token), ' ')} ELSE trim(n) END"
    return d.joined(d.each(names, "n", one), " and ")


def rules(d: Dialect) -> dict[str, tuple[str, dict[str, str]]]:
    t = lambda c: f"trim(coalesce({c}, ''))"
    low = lambda c: f"lower({t(c)})"
    j, b, h = low("journal"), low("booktitle"), low("howpublished")
    article, inproc = f"type = 'article' AND {j} <> ''", f"type = 'inproceedings' AND {b} <> ''"
    secondary = d.any_start(low("doi"), policy.PREPRINT_PREFIXES + policy.DATA_PREFIXES)
    server_j = d.any_in(j, policy.PREPRINT_SERVERS)
    inferred = "CASE " + " ".join(f"WHEN {d.starts(low('doi'), p)} THEN '{n}'" for p, n in policy.HOWPUBLISHED) + " ELSE '' END"
    pacm, series = lambda c: d.any_start(c, policy.ACM_JOURNALS), lambda c: d.any_start(c, policy.PROCEEDINGS_SERIES)
    named = lambda c: d.like(c, "(" + "|".join(policy.PROCEEDINGS_JOURNALS) + ")([ ,.;:]|$)")
    conference = lambda c: f"({d.any_in(c, ('proceedings', 'tagungsband'))} OR {d.starts(c, 'conference on')} OR contains({c}, '@'))"
    to_article = {"journal": "booktitle", "booktitle": "NULL", "type": "'article'"}
    to_inproc = {"booktitle": "journal", "journal": "NULL", "type": "'inproceedings'"}
    demote = {"type": "'misc'", "howpublished": f"CASE WHEN {t('doi')} <> '' AND NOT {secondary} THEN howpublished ELSE journal END", "journal": "NULL"}
    dash, wrapper = r"\s+[-–]\s*$", r": -\s*(.*[^\s-])\s*-$"
    url = r"\s*https?://\S+"
    cut = lambda c: d.replace(d.replace(d.replace(f"rtrim({c})", r"(\.\.\.|…)$", ""), r"\s+(in|on|for|of|and|the|a|an|with|at|to|from|by)\s*$", ""), r"[ ,;:]+$", "")
    ends = lambda c: d.like(f"rtrim(coalesce({c}, ''))", r"(\.\.\.|…)$")
    once = lambda c: f"CASE WHEN {ends(c)} THEN {cut(c)} ELSE {c} END"
    out = {
        "procedia_to_inproceedings": (f"{article} AND {series(j)}", to_inproc),
        "pacm_to_article": (f"{inproc} AND {pacm(b)}", to_article),
        "named_proceedings_to_article": (f"{inproc} AND {d.any_start(b, policy.PROCEEDINGS_JOURNALS)} AND NOT {d.any_in(b, ('conference', 'workshop', 'symposium'))}", to_article),
        "thesis_repository": (f"{inproc} AND {d.any_in(b, policy.THESIS_REPOSITORIES)}", {"school": "booktitle", "booktitle": "NULL", "type": "'phdthesis'"}),
        "repository_booktitle": (f"{inproc} AND {d.any_in(b, policy.REPOSITORIES)}", {"type": "'misc'", "booktitle": "NULL"}),
        "repository_journal": (f"{article} AND {d.any_in(j, policy.REPOSITORIES)}", {"type": "'misc'", "journal": "NULL"}),
        "preprint_booktitle": (f"{inproc} AND {b} = 'preprint'", {"type": "'misc'", "booktitle": "NULL"}),
        "inferred_booktitle": (f"{inproc} AND {b} = lower({inferred})", {"type": "'misc'", "howpublished": "booktitle", "booktitle": "NULL"}),
        "university_journal": (f"{article} AND {d.any_in(j, ('university', 'institut'))}", {"school": "journal", "journal": "NULL", "type": "'phdthesis'"}),
        "journal_prefix": (f"{inproc} AND NOT {series(b)} AND {d.any_start(b, policy.JOURNAL_PREFIXES)}", to_article),
        "handbook": (f"{inproc} AND contains({b}, 'handbook')", {"type": "'incollection'"}),
        "chapter_doi": (f"{article} AND {d.like(low('doi'), r'[.]ch[0-9]+$')}", {"booktitle": "journal", "journal": "NULL", "type": "'incollection'"}),
        "conference_journal": (f"{article} AND {t('booktitle')} = '' AND NOT {pacm(j)} AND NOT {named(j)} AND {conference(j)}", to_inproc),
        "booktitle_fixups": (f"{t('booktitle')} <> ''", {"booktitle": d.replace(d.replace(t("booktitle"), r"\s+", " "), r"\s+,", ",")}),
        "venue_urls": (f"contains({b}, 'http') OR contains({j}, 'http')", {c: f"coalesce(nullif(trim({d.replace(c, url, '')}), ''), {c})" for c in ("booktitle", "journal")}),
        "publisher_table": (f"{t('publisher')} <> '' AND {d.any_in(j, policy.PUBLISHERS)}", {"publisher": "CASE " + " ".join(f"WHEN contains({j}, '{k}') THEN '{v}'" for k, v in policy.PUBLISHERS.items()) + " ELSE publisher END"}),
        "publisher_is_container": (f"{t('publisher')} <> '' AND {low('publisher')} = lower(coalesce(nullif({t('journal')}, ''), nullif({t('booktitle')}, ''), {t('howpublished')}))", {"publisher": "NULL"}),
        "venue_full": (f"{b} <> '' OR {j} <> ''", {c: d.table(low(c), policy.VENUE_FULL.items(), c) for c in ("booktitle", "journal")}),
        "venue_case": (f"{b} <> '' OR {j} <> ''", {c: d.table(t(c), policy.VENUE_CASE.items(), c) for c in ("booktitle", "journal")}),
        "osf_version": (d.like(low("doi"), r"^10[.]312(34|19)/osf[.]io/.*_v[0-9]+$"), {"doi": d.replace("doi", r"_v[0-9]+$", ""), "url": d.replace("url", r"_v[0-9]+$", "")}),
        "pages_in_booktitle": (d.like(t("booktitle"), r", [0-9]+:[0-9]+\s*-\s*[0-9]+:[0-9]+$"), {"booktitle": d.replace("booktitle", r", [0-9]+:[0-9]+\s*-\s*[0-9]+:[0-9]+$", ""), "pages": f"coalesce(pages, replace({d.group('booktitle', r', ([0-9]+:[0-9]+[ ]*-[ ]*[0-9]+:[0-9]+)$')}, ' ', ''))"}),
        "proceedings_twice": (d.starts(b, "proceedings of the extended abstracts"), {"booktitle": "substring(trim(booktitle), 20)"}),
        "preprint_marker": (d.like(low("title"), r"\[preprint\]\s*$"), {"title": f"trim({d.replace('title', r'(?i)\s*\[preprint\]\s*$', '')})"}),
        "bracket_j": (d.like(t("title"), r"\[J\]\s*$"), {"title": f"trim({d.replace('title', r'\s*\[J\]\s*$', '')})"}),
        "trailing_dash": (f"{d.like(t('booktitle'), dash)} OR {d.like(t('title'), dash)}", {c: d.replace(c, dash, "") for c in ("booktitle", "title")}),
        "subtitle_wrapper": (f"contains(coalesce(title, ''), ': -')", {"title": d.replace("title", wrapper, r": \1")}),
        "pages_without_digits": (f"{t('pages')} <> '' AND NOT {d.like(t('pages'), '[0-9]')}", {"pages": "NULL"}),
        "url_from_doi": (f"{t('doi')} <> '' AND {t('url')} = ''", {"url": "'https://doi.org/' || trim(doi)"}),
        "preprint_journal_load": (f"{j} <> '' AND {server_j}", {"type": "CASE WHEN type = 'article' THEN 'misc' ELSE type END", "howpublished": f"CASE WHEN type <> 'article' OR ({t('doi')} <> '' AND NOT {secondary}) THEN howpublished ELSE journal END", "journal": "NULL"}),
        "author_email": (d.like(t("author"), r"[^\s]+@[^\s]+[.][a-z]+"), {"author": f"trim({d.replace(d.replace('author', r'<?[^\s<]+@[^\s>]+[.][a-z]+>?', ''), r'\s+and\s*$', '')})"}),
        "unpublished_load": (f"{article} AND {j} = 'unpublished'", {"type": "'misc'", "journal": "NULL", "publisher": "NULL"}),
        "unpublished": (f"{article} AND {j} = 'unpublished'", {"type": "'misc'", "journal": "NULL"}),
        "secondary_doi_of_article": (f"{article} AND {secondary} AND ({t('volume')} <> '' OR {t('pages')} <> '')", {"doi": "NULL", "url": "NULL"}),
        "article_without_journal": (f"type = 'article' AND {j} = ''", {"type": "'misc'"}),
        "inproceedings_without_booktitle": (f"type = 'inproceedings' AND {b} = ''", {"type": "'misc'"}),
        "preprint_journal": (f"{article} AND {server_j}", demote),
        "ellipsis": (" OR ".join(ends(c) for c in ("journal", "booktitle", "title")), {c: once(c) for c in ("journal", "booktitle", "title")}),
        "patent": (f"{article} AND {d.starts(j, 'us patent')}", {"type": "'misc'", "howpublished": "trim(journal)", "journal": "NULL"}),
        "url_booktitle": (f"{inproc} AND {d.like(b, r'^(https?://|www[.])')}", {"type": "'misc'", "booktitle": "NULL"}),
        "article_with_preprint_doi": (f"type = 'article' AND {secondary}", {
            "type": f"CASE WHEN {j} <> '' AND ({t('volume')} <> '' OR {t('pages')} <> '') THEN type ELSE 'misc' END",
            "doi": f"CASE WHEN {j} <> '' AND ({t('volume')} <> '' OR {t('pages')} <> '') THEN NULL ELSE doi END",
            "url": f"CASE WHEN {j} <> '' AND ({t('volume')} <> '' OR {t('pages')} <> '') THEN NULL ELSE url END",
            "howpublished": f"CASE WHEN {j} <> '' AND {t('volume')} = '' AND {t('pages')} = '' THEN journal ELSE howpublished END",
            "journal": f"CASE WHEN {t('volume')} <> '' OR {t('pages')} <> '' THEN journal ELSE NULL END"}),
        "backfill_howpublished": (f"type = 'misc' AND {h} = '' AND {inferred} <> ''", {"howpublished": inferred}),
        "normalize_howpublished": (f"{h} <> ''", {"howpublished": d.table(h, policy.HOWPUBLISHED_CASE.items(), "howpublished")}),
        "qualify_arxiv": (f"{t('howpublished')} = 'arXiv' AND {t('eprint')} <> ''", {"howpublished": "'arXiv:' || trim(eprint)"}),
        "conference_howpublished": (f"type = 'misc' AND {h} <> '' AND {d.any_in(h, policy.CONFERENCE_WORDS)} AND NOT {named(h)} AND NOT {d.any_in(h, policy.PREPRINT_SERVERS)} AND NOT {d.any_in(h, policy.REPOSITORIES)} AND {h} <> lower({inferred})", {"type": "'inproceedings'", "booktitle": "howpublished", "howpublished": "NULL"}),
        "preprint_publisher": (f"{low('publisher')} IN ({', '.join(repr(p) for p in policy.PREPRINT_PUBLISHERS)}) AND {j} <> '' AND NOT {server_j}", {"publisher": "NULL"}),
        "note": ("note IS NOT NULL", {"note": "NULL"}),
        "spire_suffix": (f"contains({b}, 'spire')", {"booktitle": d.replace("booktitle", r"\s*:\s*SPIRE\b.*$", "")}),
        # a fixed value: the publisher's name with its umlaut
        "zentrum_umlaut": ("contains(coalesce(publisher, ''), 'Zentrum fur Informatik')", {"publisher": "replace(publisher, 'Zentrum fur Informatik', 'Zentrum f{' || chr(92) || '\"u}r Informatik')"}),
        "title_text": (f"{t('title')} <> ''", {"title": fixed_title(d, "title")}),
        "caps_title": (f"{t('title')} <> ''", {"title": trimmed_title(d, "title")}),
        "author_case": (f"{t('author')} <> ''", {"author": cased_author(d, "author")}),
    }
    return out


# Rules that are several others, one after the other.
CHAINS = {"title_chain": ("caps_title", "bracket_j", "preprint_marker", "title_text", "trailing_dash", "subtitle_wrapper")}

# The order of the rules in each stage.
STAGES = {
    "load_repair": (
        "note", "preprint_journal_load", "author_email", "bracket_j", "ellipsis", "venue_full", "venue_case",
        "publisher_is_container", "trailing_dash", "subtitle_wrapper", "spire_suffix", "osf_version", "zentrum_umlaut",
        "pages_in_booktitle", "proceedings_twice", "caps_title", "conference_journal", "unpublished_load", "patent", "repository_journal", "university_journal",
        "procedia_to_inproceedings", "pacm_to_article", "named_proceedings_to_article", "thesis_repository",
        "repository_booktitle", "preprint_booktitle", "inferred_booktitle", "journal_prefix", "handbook", "chapter_doi",
        "preprint_marker", "title_text", "booktitle_fixups", "venue_urls", "publisher_table", "secondary_doi_of_article",
        "backfill_howpublished", "author_case", "normalize_howpublished", "qualify_arxiv", "publisher_is_container",
    ),
    "post_merge": (
        "note", "article_without_journal", "inproceedings_without_booktitle", "preprint_journal", "ellipsis",
        "conference_journal", "procedia_to_inproceedings", "pacm_to_article", "named_proceedings_to_article",
        "thesis_repository", "patent", "unpublished", "url_booktitle", "preprint_booktitle", "inferred_booktitle",
        "journal_prefix", "handbook", "chapter_doi", "repository_journal", "repository_booktitle", "university_journal",
        "article_with_preprint_doi", "backfill_howpublished", "title_chain", "trailing_dash", "booktitle_fixups", "venue_full",
        "venue_case", "publisher_is_container", "spire_suffix", "osf_version", "zentrum_umlaut", "pages_in_booktitle",
        "proceedings_twice", "venue_urls", "publisher_table", "author_case", "normalize_howpublished",
        "qualify_arxiv", "conference_howpublished",
    ),
    "postrun": (
        "note", "ellipsis", "procedia_to_inproceedings", "pacm_to_article", "named_proceedings_to_article",
        "thesis_repository", "repository_booktitle", "repository_journal", "preprint_booktitle", "inferred_booktitle",
        "university_journal", "journal_prefix", "handbook", "chapter_doi", "conference_journal", "preprint_marker",
        "booktitle_fixups", "venue_urls", "publisher_table", "publisher_is_container", "venue_full", "venue_case",
        "trailing_dash", "subtitle_wrapper", "osf_version", "pages_without_digits", "pages_in_booktitle",
        "proceedings_twice", "url_from_doi", "normalize_howpublished", "qualify_arxiv",
    ),
    "finalize": ("preprint_publisher", "note"),
}


def _unchained(names) -> list[str]:
    return [x for name in names for x in CHAINS.get(name, (name,))]


def apply(entries: DataFrame, names) -> DataFrame:
    """`entries` after the named rules in order; other columns pass."""
    table = rules(SPARK)
    for name in _unchained(names):
        guard, values = table[name]
        changed = {c: F.expr(f"CASE WHEN {guard} THEN {v} ELSE {c} END") for c, v in values.items()}
        entries = entries.withColumns(changed)
    return entries


def canonicalize(entries: DataFrame, stage: str) -> DataFrame:
    return apply(entries, STAGES[stage])


def oracle(names, source: str, keys: str) -> str:
    """SQL text of the same rules as nested subqueries."""
    table = rules(DUCK)
    sql = f"SELECT {keys}, {', '.join(COLUMNS)} FROM {source}"
    for name in _unchained(names):
        guard, values = table[name]
        cols = [f"CASE WHEN {guard} THEN {values[c]} ELSE {c} END AS {c}" if c in values else c for c in COLUMNS]
        sql = f"SELECT {keys}, {', '.join(cols)} FROM ({sql})"
    return sql
