"""Venue predicates and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import policy

from .ids import is_preprint_doi
from .text import any_of, starts_with_any, text


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for the key, or null; one map literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def is_preprint_server(c: str | Column) -> Column:
    return any_of(F.lower(text(c)), policy.PREPRINT_SERVERS)


def is_preprint_record(doi: Column, journal: Column) -> Column:
    """The record-level predicate: preprint DOI (not data DOI), or a server's name as journal."""
    return is_preprint_doi(doi) | is_preprint_server(journal)


def is_named_proceedings(c: Column) -> Column:
    """A journal that is called proceedings."""
    return F.lower(c).rlike("(" + "|".join(policy.PROCEEDINGS_JOURNALS) + ")([ ,.;:]|$)")


def is_conference_journal(c: str | Column) -> Column:
    s = text(c)
    low = F.lower(s)
    return ~is_named_proceedings(s) & (
        any_of(low, ("proceedings", "tagungsband")) | F.startswith(low, F.lit("conference on")) | F.contains(s, F.lit("@"))
    )


def howpublished_of(doi: str | Column) -> Column:
    low = F.lower(text(doi))
    out = F.lit(None).cast("string")
    for prefix, name in reversed(policy.HOWPUBLISHED):
        out = F.when(F.startswith(low, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def venue_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(is_preprint_server(c), "preprint").when(any_of(low, policy.CONFERENCE_WORDS), "conference").otherwise("journal")


__all__ = ["lookup", "is_preprint_server", "is_preprint_record", "is_named_proceedings", "is_conference_journal", "howpublished_of", "venue_type", "starts_with_any"]
