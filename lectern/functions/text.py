"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåāăąçćčĉďđèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťţùúûüūůűýÿźžż"
_PLAIN = "aaaaaaaaaccccddeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"
PUNCTUATION = r"[,.;:!?\n\t\r'\"\-()\[\]{}~]"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def latex_macros() -> dict[str, str]:
    """Letters up to U+024F with the macro that writes each: base letter and mark by their decomposition."""
    marks = dict(zip("\u0300\u0301\u0302\u0303\u0308\u0304\u0307", "`'^~\"=.")) | dict(zip("\u030a\u030b\u030c\u0306\u0327\u0328\u0323", "rHvuckd"))
    out = {"ß": r"{\ss}", "ø": r"{\o}", "Ø": r"{\O}", "æ": r"{\ae}", "Æ": r"{\AE}", "œ": r"{\oe}", "Œ": r"{\OE}", "ł": r"{\l}", "Ł": r"{\L}", "ı": r"{\i}"}
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and parts[1] in marks:
            mark = marks[parts[1]]
            base = "\\" + parts[0] if parts[0] in "ij" and mark not in "ckd" else parts[0]  # without its dot
            out[chr(point)] = f"{{\\{mark}{{{base}}}}}" if mark.isalpha() else f"{{\\{mark}{base}}}"
    return out


def text(c: str | Column) -> Column:
    """The column, with null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def any_of(c: Column, parts) -> Column:
    """Whether any of `parts` occurs in the column."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in parts))


def starts_with_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(p)) for p in parts))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; sharp s and ligatures spelt out."""
    out = F.translate(c, _ACCENTED + _ACCENTED.upper(), _PLAIN + _PLAIN.upper())
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def strip_html(c: Column) -> Column:
    """Tags out, entities decoded, white space collapsed."""
    return collapse(unescape(F.regexp_replace(c, r"<[^>]*>", " ")))


def latex_to_text(c: Column) -> Column:
    """Formulas out, accent macros to their letter, other macros to their argument."""
    out = F.regexp_replace(c, r"\$[^$]*\$", "")
    out = F.regexp_replace(out, r"\{(\\[\"'`^~=.]\s*\{?\\?[A-Za-z]\}?)\}", "$1")
    out = F.regexp_replace(out, r"\\[\"'`^~=.]\s*\{?\\?([A-Za-z])\}?", "$1")
    out = F.regexp_replace(out, r"\\[A-Za-z]+\s*\{([^{}]*)\}", "$1")
    return F.regexp_replace(out, r"\\([&%$#_])", "$1")


def normalize_title(c: str | Column) -> Column:
    """Lower-case words of a title; null is the empty string."""
    out = strip_accents(latex_to_text(unescape(text(c))))
    return collapse(F.regexp_replace(F.lower(out), PUNCTUATION, " "))


def normalize_name(c: str | Column) -> Column:
    out = F.lower(strip_accents(latex_to_text(text(c))))
    out = F.regexp_replace(out, "['’ʼ]", "")
    return collapse(F.regexp_replace(out, r"[^a-z0-9\s]", " "))


def is_placeholder(c: str | Column) -> Column:
    """Values that stand for a missing one."""
    s = F.trim(text(c))
    low = F.lower(s)
    return (
        (s == "")
        | ((F.contains(s, F.lit("...")) | F.contains(s, F.lit("…"))) & (F.length(s) < 50))
        | any_of(low, ("et al", "n/a", "tbd", "unknown", "placeholder"))
    )


def strip_ellipsis(c: Column) -> Column:
    """A cut-off value without its dots and the preposition they leave hanging."""
    s = F.rtrim(c)
    cut = F.rtrim(F.regexp_replace(s, r"(\.\.\.|…)$", ""))
    cut = F.regexp_replace(cut, r"(?i)\s+(in|on|for|of|and|the|a|an|with|at|to|from|by)\s*$", "")
    return F.when(s.rlike(r"(\.\.\.|…)$"), F.regexp_replace(cut, r"[ ,;:]+$", "")).otherwise(c)


def trim_title(c: str | Column) -> Column:
    """Trimmed, without one or two final dots; a title in capitals gets sentence case per word."""
    s = F.trim(text(c))
    kept = F.when(s.rlike(r"(\.\.\.|…)$"), s).otherwise(F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(s, r"\*+$", "")), r"(?<!\.)\.{1,2}$", "")))
    letters = F.length(F.regexp_replace(kept, r"[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(kept, r"[^A-Z]", ""))
    return F.when((letters > 0) & (capitals > letters * 0.6), F.initcap(F.lower(kept))).otherwise(kept)


def sanitize_title(c: str | Column) -> Column:
    """A subtitle that repeats the title goes, and so does a final full stop."""
    s = F.trim(text(c))
    head, tail = F.trim(F.substring_index(s, ":", 1)), F.trim(F.substring_index(s, ":", -1))
    once = F.when(F.contains(s, F.lit(":")) & (F.lower(head) == F.lower(tail)), head).otherwise(s)
    return F.regexp_replace(once, r"(?<!\.)\.$", "")


def ascii_field(c: str | Column) -> Column:
    """Typographic quotes and dashes as ASCII, accented letters as macros (macros that are there stay as they are),
    ampersands escaped once. Letters without a macro lose their marks."""
    s = F.translate(text(c), "‘’“”–—", "''\"\"--")
    macros = F.create_map(*[F.lit(x) for pair in latex_macros().items() for x in pair])
    letters = F.transform(F.split(s, ""), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(macros, x), x)).otherwise(x))
    s = F.when(s.rlike(r"[^\x00-\x7F]"), F.array_join(letters, "")).otherwise(s)
    return F.regexp_replace(strip_accents(s), r"(?<!\\)&", r"\\&")


def truncated_match(a: Column, b: Column, least: int = 15) -> Column:
    """Whether one normalised title is a proper beginning or end of the other."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long_ = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != b) & (F.length(short) >= least) & (F.startswith(long_, short) | F.endswith(long_, short))
