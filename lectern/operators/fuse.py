"""Fusion of the records of a work under a source-trust policy.

Sources arrive in the order of `seq`. A free field goes to the best-ranked, then first, value that is no
placeholder. A field that belongs to the version (volume, year, publisher ...) follows the published
version: if a secondary DOI came before the first published one, the record that brought the published
DOI outweighs what came before it. The DOI prefers published ones. Guarded fields are folds in order.
All fields of a work come from one shuffle by work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions import ids, text

VERSION_FIELDS = ("year", "volume", "publisher")
FREE_FIELDS = ("booktitle", "pages")


def _best(field: str, key: Column, extra: Column | None = None) -> Column:
    usable = ~text.is_placeholder(field)
    if extra is not None:
        usable &= extra
    return F.min_by(F.struct(F.col(field).alias("value"), "source"), F.when(usable, key))


def with_version(records: DataFrame) -> DataFrame:
    """`records` with p (seq of the first published DOI) and flagged (a secondary DOI came before it)."""
    work = W.partitionBy("work_id")
    secondary = ids.is_secondary_doi(F.col("doi"))
    present = ~text.is_placeholder("doi")
    return (
        records.withColumn("p", F.min(F.when(present & ~secondary, F.col("seq"))).over(work))
        .withColumn("first_secondary", F.min(F.when(present & secondary, F.col("seq"))).over(work))
        .withColumn("flagged", F.coalesce(F.col("first_secondary") < F.col("p"), F.lit(False)))
    )


def fuse(records: DataFrame) -> DataFrame:
    """One row per work: the value and the source of each free, version and DOI field, and counts."""
    key = F.struct("source_rank", "seq")
    doi_key = F.struct(ids.is_secondary_doi(F.col("doi")).alias("s"), "source_rank", "seq")
    aggs = [_best(f, key).alias(f) for f in FREE_FIELDS]
    aggs.append(_best("doi", doi_key).alias("doi"))
    for f in VERSION_FIELDS:
        aggs.append(_best(f, key).alias(f"{f}_any"))
        aggs.append(_best(f, key, F.col("flagged") & (F.col("seq") >= F.col("p"))).alias(f"{f}_late"))
        aggs.append(F.coalesce(F.bool_or(F.col("flagged") & (F.col("seq") == F.col("p")) & ~text.is_placeholder(f)), F.lit(False)).alias(f"{f}_at_p"))
    wide = with_version(records).groupBy("work_id").agg(
        *aggs, F.count("*").alias("n_records"), F.count_distinct("source").alias("trust_hits"), F.min_by("type", key).alias("type")
    )
    cols = [F.col("work_id"), F.col("type"), F.col("n_records"), F.col("trust_hits")]
    for f in (*FREE_FIELDS, "doi"):
        cols += [F.col(f)["value"].alias(f), F.col(f)["source"].alias(f"{f}_source")]
    for f in VERSION_FIELDS:
        won = F.when(F.col(f"{f}_at_p"), F.col(f"{f}_late")).otherwise(F.col(f"{f}_any"))
        cols += [won["value"].alias(f), won["source"].alias(f"{f}_source")]
    return wide.select(*cols)


def _fold(records: DataFrame, field: str, accept) -> DataFrame:
    """(work_id, field, source) by visiting the values of `field` in order of seq; accept(now, new) tells
    whether the new (value, rank, source) replaces the present one."""
    item = F.struct("seq", "source_rank", F.col(field).alias("value"), "source")
    usable = records.where(~text.is_placeholder(field))
    visits = usable.groupBy("work_id").agg(F.array_sort(F.collect_list(item)).alias("visits"))
    start = F.get("visits", F.lit(0))
    last = F.aggregate(
        F.slice("visits", F.lit(2), F.greatest(F.size("visits") - 1, F.lit(1))), start,
        lambda now, new: F.when(accept(now, new), new).otherwise(now),
    )
    return visits.withColumn("last", last).select("work_id", F.col("last")["value"].alias(field), F.col("last")["source"].alias("source"))


def better(now: Column, new: Column, by: int = 1) -> Column:
    return now["source_rank"] - new["source_rank"] >= by


def title_guard(now: Column, new: Column) -> Column:
    """A title of less than 70 % of the present length needs a source at least three ranks better."""
    short = F.length(new["value"]) < F.length(now["value"]) * 0.7
    return F.when(short, better(now, new, 3)).otherwise(better(now, new))


def author_guard(now: Column, new: Column) -> Column:
    """A shorter list of names needs a source at least three ranks better."""
    from lectern.functions.people import parse_authors

    fewer = F.size(parse_authors(new["value"])) < F.size(parse_authors(now["value"]))
    return F.when(fewer, better(now, new, 3)).otherwise(better(now, new))


def journal_guard(now: Column, new: Column) -> Column:
    """A journal is never replaced by a preprint server, and always replaces one."""
    from lectern.functions.venues import is_preprint_server

    was, is_ = is_preprint_server(now["value"]), is_preprint_server(new["value"])
    return F.when(~was & is_, False).when(was & ~is_, True).otherwise(better(now, new))


def booktitle_guard(now: Column, new: Column) -> Column:
    """A generic series gives way to a named conference, which it does not replace."""
    from lectern import policy

    generic = lambda c: F.lower(c["value"]).isin(*policy.GENERIC_SERIES)
    return F.when(~generic(now) & generic(new), False).when(generic(now) & ~generic(new), True).otherwise(better(now, new))


GUARDS = {"title": title_guard, "author": author_guard, "journal": journal_guard, "booktitle": booktitle_guard}


def fold_field(records: DataFrame, field: str) -> DataFrame:
    return _fold(records, field, GUARDS[field])


def fold_all(records: DataFrame, fields=tuple(GUARDS)) -> DataFrame:
    """(work_id, each field and its source): all guarded folds over one shuffle by work."""
    item = F.struct("seq", "source_rank", "source", *fields)
    visits = records.groupBy("work_id").agg(F.array_sort(F.collect_list(item)).alias("visits"))

    def last(field: str) -> Column:
        items = F.filter(
            F.transform("visits", lambda v: F.struct(v["seq"].alias("seq"), v["source_rank"].alias("source_rank"), v[field].alias("value"), v["source"].alias("source"))),
            lambda v: ~text.is_placeholder(v["value"]),
        )
        return F.when(F.size(items) > 0, F.aggregate(
            F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(1))), F.get(items, F.lit(0)),
            lambda now, new: F.when(GUARDS[field](now, new), new).otherwise(now),
        ))

    found = visits.select("work_id", *[last(f).alias(f) for f in fields])
    return found.select("work_id", *[x for f in fields for x in (F.col(f)["value"].alias(f), F.col(f)["source"].alias(f"{f}_source"))])


def entries(records: DataFrame) -> DataFrame:
    """One whole entry per work: free, version and DOI fields as `fuse` elects them, guarded fields by their folds."""
    guarded = fold_all(records)
    return fuse(records).drop("booktitle", "booktitle_source").join(guarded, "work_id")


def provenance(records: DataFrame, fields=("doi", *FREE_FIELDS)) -> DataFrame:
    """(work_id, field, seq, source, value, selected): every value that stood for election; one is selected."""
    long = records.select(
        "work_id", "seq", "source", "source_rank",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"),
    ).select("work_id", "seq", "source", "source_rank", "x.*").where(~text.is_placeholder("value"))
    secondary = (F.col("field") == "doi") & ids.is_secondary_doi(F.col("value"))
    first = W.partitionBy("work_id", "field").orderBy(secondary, "source_rank", "seq")
    return long.select("work_id", "field", "seq", "source", "value", (F.row_number().over(first) == 1).alias("selected"))
