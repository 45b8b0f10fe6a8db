"""DuckDB expressions that the oracle SQL of several queries shares."""

from __future__ import annotations

from lectern import policy

_PLAIN = "'[,.;:!?\\n\\t\\r''\"\\-()\\[\\]{}~]'"


def strip_accents(c: str) -> str:
    return f"replace(replace(strip_accents({c}), 'ß', 'ss'), 'œ', 'oe')"


def latex(c: str) -> str:
    """Accented letters of the fixtures as macros, written out."""
    marks = {"é": "\\'e", "ó": "\\'o", "è": "\\`e", "ñ": "\\~n", "ç": "\\c{c}", "ü": '\\"u', "ê": "\\^e", "ä": '\\"a', "ö": '\\"o', "í": "\\'\\i", "ő": "\\H{o}", "ß": "\\ss",
             "É": "\\'E", "È": "\\`E", "Ñ": "\\~N", "Ó": "\\'O", "Ç": "\\c{C}", "Ä": '\\"A', "Ê": "\\^E", "Ü": '\\"U', "Ö": '\\"O', "Í": "\\'\\I"}
    for letter, macro in marks.items():
        escaped = macro.replace("'", "''")
        c = f"replace({c}, '{letter}', '{{{escaped}}}')"
    return c


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def norm_title(c: str) -> str:
    return collapse(f"regexp_replace(lower({strip_accents(f"regexp_replace({_blank(c)}, '[$][^$]*[$]', '', 'g')")}), {_PLAIN}, ' ', 'g')")


def _blank(c: str) -> str:
    return f"coalesce({c}, '')"


def norm_name(c: str) -> str:
    return collapse(f"regexp_replace(regexp_replace(lower({strip_accents(_blank(c))}), '[''’ʼ]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g')")


def starts_any(c: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with(lower({_blank(c)}), '{p}')" for p in prefixes) + ")"


def contains_any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower({_blank(c)}), '{p}')" for p in parts) + ")"


def is_secondary(c: str) -> str:
    return starts_any(c, policy.PREPRINT_PREFIXES + policy.DATA_PREFIXES)


def is_preprint_doi(c: str) -> str:
    return starts_any(c, policy.PREPRINT_PREFIXES)


def is_server(c: str) -> str:
    return contains_any(c, policy.PREPRINT_SERVERS)


def placeholder(c: str) -> str:
    s = f"trim({_blank(c)})"
    return (f"({s} = '' OR ((contains({s}, '...') OR contains({s}, '…')) AND len({s}) < 50) OR "
            + contains_any(s, ("et al", "n/a", "tbd", "unknown", "placeholder")) + ")")


def ratio(a: str, b: str) -> str:
    """Indel ratio by a bit-parallel longest common subsequence."""
    mask = f"((1::HUGEINT << len({a})::INT) - 1)"
    hit = (f"coalesce(list_sum(list_transform(list_filter(range(1, len({a}) + 1), lambda i: unicode(substr({a}, i, 1)) = c),"
           " lambda i: 1::HUGEINT << (i - 1)::INT)), 0)::HUGEINT")
    final = (f"list_reduce(list_transform(string_split({b}, ''), lambda x: unicode(x)::HUGEINT),"
             f" lambda v, c: ((v + (v & {hit})) | (v - (v & {hit}))) & {mask}, {mask})")
    return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE"
            f" ELSE 2.0::DOUBLE * (len({a}) - bit_count({final})) / (len({a}) + len({b})) END")


def signature(n: str) -> str:
    """Struct (last, initials) of a name."""
    clean = norm_name(n)
    parts = "[" + ", ".join(f"'{p}'" for p in policy.PARTICLES) + "]"
    first = lambda ws: f"list_aggregate(list_transform(list_filter({ws}, lambda w: w <> ''), lambda w: w[1]), 'string_agg', '')"
    glued = lambda s: f"regexp_replace({s}, '[^a-z0-9]', '', 'g')"
    tok = f"string_split({clean}, ' ')"
    start = (f"coalesce(list_max(list_filter(range(1, len({tok})), lambda i: NOT list_contains({parts}, {tok}[i])))::BIGINT, 0) + 1")
    raw = f"string_split({collapse(n)}, ' ')"
    return (f"CASE WHEN {clean} = '' THEN NULL WHEN contains({n}, ',') THEN "
            f"{{'last': {glued(norm_name(f'split_part({n}, chr(44), 1)'))}, 'initials': coalesce({first(f'string_split({norm_name(f'split_part({n}, chr(44), 2)')}, chr(32))')}, '')}} "
            f"WHEN len({tok}) = 2 AND len({raw}) = 2 AND regexp_full_match(replace({raw}[2], '.', ''), '[A-Z]{{1,4}}') THEN "
            f"{{'last': {glued(f'{tok}[1]')}, 'initials': regexp_replace({tok}[2], '[^a-z]', '', 'g')}} "
            f"ELSE {{'last': {glued(f'array_to_string({tok}[{start}:], chr(32))')}, "
            f"'initials': coalesce({first(f'{tok}[1:{start} - 1]')}, '')}} END")


def signatures(author: str) -> str:
    """Distinct signatures of a list that is parted by " and "."""
    return f"list_distinct(list_transform(string_split({author}, ' and '), lambda n: {signature('n')}))"


def compatible(x: str, y: str) -> str:
    return f"(starts_with({x}, {y}) OR starts_with({y}, {x}))"
