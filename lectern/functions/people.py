"""Author lists and name signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import policy

from .text import normalize_name, text


def parse_authors(c: str | Column) -> Column:
    """Names of an author string: parted by "and", else by semicolons; "et al." and "others" go."""
    s = F.trim(text(c))
    by_and = F.split(s, r"(?i)\s+and\s+")
    by_semicolon = F.split(s, r"\s*;\s*")
    names = F.when(s.rlike(r"(?i)\s+and\s+"), by_and).otherwise(by_semicolon)
    names = F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"(?i),?\s*et al\.?$", "")))
    return F.filter(names, lambda n: (n != "") & (F.lower(n) != "others"))


def _first_letters(words: Column) -> Column:
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def signature(name: Column) -> Column:
    """Struct (last, initials) of one name: "Last, First", "First Last" with particles, or "Last INITIALS"."""
    clean = normalize_name(name)
    tokens = F.split(clean, " ")
    raw = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    comma = F.contains(name, F.lit(","))
    parts = F.split(name, ",")
    glued = lambda s: F.regexp_replace(s, r"[^a-z0-9]", "")
    # the surname starts at the last run of particles before the final token
    particles = F.array(*[F.lit(p) for p in policy.PARTICLES])
    n = F.size(tokens)
    run = F.aggregate(
        F.slice(F.reverse(tokens), F.lit(2), F.greatest(n - 1, F.lit(1))),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda a, w: F.struct(
            (a["k"] + F.when(a["on"] & F.array_contains(particles, w), 1).otherwise(0)).alias("k"),
            (a["on"] & F.array_contains(particles, w)).alias("on"),
        ),
    )["k"]
    start = n - run
    initials_token = F.regexp_replace(F.element_at(raw, -1), r"\.", "")
    compact = (n == 2) & (F.size(raw) == 2) & initials_token.rlike("^[A-Z]{1,4}$") & ~F.lower(initials_token).isin(
        "jr", "sr", "ii", "iii", "iv", "md", "phd"
    )
    by_comma = F.struct(
        glued(normalize_name(F.get(parts, F.lit(0)))).alias("last"),
        _first_letters(F.split(normalize_name(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), " ")).alias("initials"),
    )
    by_initials = F.struct(
        glued(F.get(tokens, F.lit(0))).alias("last"),
        F.regexp_replace(F.coalesce(F.get(tokens, F.lit(1)), F.lit("")), "[^a-z]", "").alias("initials"),
    )
    plain = F.struct(
        glued(F.array_join(F.slice(tokens, start, run + 1), "")).alias("last"),
        _first_letters(F.slice(tokens, F.lit(1), start - 1)).alias("initials"),
    )
    return F.when(clean == "", None).when(comma, by_comma).when(compact, by_initials).otherwise(plain)


def signatures(authors: Column) -> Column:
    """Distinct signatures with a surname of a list of names."""
    return F.array_distinct(F.filter(F.transform(authors, signature), lambda s: F.coalesce(s["last"], F.lit("")) != ""))


def _compatible(x: Column, y: Column) -> Column:
    return F.startswith(x, y) | F.startswith(y, x)


def overlap(a: Column, b: Column) -> Column:
    """Whether two lists of signatures share a person."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["last"] == y["last"]) & _compatible(x["initials"], y["initials"])))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Jaccard coefficient with one-to-one matches, the most specific signatures first, exact initials preferred."""
    longest_first = F.array_sort(
        F.transform(a, lambda x: F.struct((-F.length(x["initials"])).alias("k"), x["initials"].alias("initials"), x["last"].alias("last")))
    )
    shape = "array<struct<last:string,initials:string>>"
    state = F.struct(b.cast(shape).alias("left"), F.lit(0).alias("hits"))

    def step(s: Column, x: Column) -> Column:
        fits = F.filter(s["left"], lambda y: (y["last"] == x["last"]) & _compatible(x["initials"], y["initials"]))
        ranked = F.array_sort(F.transform(fits, lambda y: F.struct(
            (y["initials"] != x["initials"]).alias("e"), (-F.length(y["initials"])).alias("k"),
            y["initials"].alias("initials"), y["last"].alias("last"),
        )))
        best = F.get(ranked, F.lit(0))
        rest = F.filter(s["left"], lambda y: ~((y["last"] == best["last"]) & (y["initials"] == best["initials"])))
        return F.struct(
            F.when(best.isNull(), s["left"]).otherwise(rest).cast(shape).alias("left"),
            (s["hits"] + F.when(best.isNull(), 0).otherwise(1)).alias("hits"),
        )

    hits = F.aggregate(longest_first, state, step)["hits"]
    union = F.size(a) + F.size(b) - hits
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(hits / union)


def last_name(c: Column) -> Column:
    """The surname of one name as written."""
    s = F.trim(text(c))
    return F.when(F.contains(s, F.lit(",")), F.trim(F.substring_index(s, ",", 1))).otherwise(F.element_at(F.split(s, r"\s+"), -1))
