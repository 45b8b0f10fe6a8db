"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key. Within a source, rows are ordered by key; the key's leading digits
deal the rows of every source, however large, over even range buckets. Bucket totals give each bucket's
offset, a running sum inside the bucket the rest: a distributed prefix sum of sizes. A source's budget
of words is spent along that order: whole epochs first, then rows up to the exact cut.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that
repeat each count; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(row_id: str, seed: str) -> Column:
    """A key that depends on the row's id and the seed only, so that reruns agree."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(row_id).cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): `share` of all sizes dealt by weight,
    at most `most` times a source's size, the excess dealt again by weight until no target is above.

    That is the level L with sum(min(L * weight, cap)) = share: sources capped at L are a prefix of the
    order by cap / weight. The windows run over one row per source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy("ratio", "place")
    every = W.partitionBy()
    level = (
        sizes.withColumn("place", F.row_number().over(rank) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("spent", F.coalesce(F.sum("cap").over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", F.col("ratio") * F.col("open") <= F.col("total") - F.col("spent"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every))
        .withColumn("over", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every))
    )
    return level.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("left") * F.col("weight") / F.col("over")).alias("target"),
    )


def plan(
    docs: DataFrame, weights: list[float], share: float, most: float, seed: str, row_id: str = "doc_id", key: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, source, size, key, source_size, target, whole, rest, before) and the table of sources.

    `whole` epochs take every row; of one more epoch, `rest` words are taken in key order; `before` is
    the number of words that precede the row in its source."""
    key = random_key(row_id, seed) if key is None else key
    slim = cut(docs.select(row_id, "source", words("text").alias("size"), key.alias("key")))
    slim = slim.withColumn("bucket", F.substring("key", 1, 2))
    buckets = cut(slim.groupBy("source", "bucket").agg(F.sum("size").alias("held")))
    sources = (
        targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, most)
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
    )
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    head = offsets.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source")).select(
        F.col("o.source").alias("of"), F.col("o.bucket").alias("at"),
        "offset", "source_size", "target", "whole", "rest",
    )
    inside = W.partitionBy("source", "bucket").orderBy("key", F.col(row_id).asc_nulls_last(), "size")
    rows = (
        slim.withColumn("run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(head, F.expr("source <=> of and bucket = at"))
        .withColumn("before", F.col("offset") + F.col("run") - F.col("size"))
    )
    return rows, sources


def taken() -> Column:
    """Words the mix takes of a row of `plan`: at the cut, the last document gives its words up to the budget."""
    return F.col("whole") * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))
    )


def mix(docs: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0, seed="mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`."""
    rows, _ = plan(docs, list(weights), share, most, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken().cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0, seed="mix") -> DataFrame:
    """`docs` with each row as often as the mix takes it, rounded to whole documents at a source's cut.

    A row's key holds a hash of all its columns, so rows of one key are equal and stand for each other. The cut is
    carried as one key per source and how many rows of that key it takes: the texts are neither sorted nor joined
    by id, and rows with a null or repeated id are cut as exactly as others."""
    mark = F.xxhash64(*docs.columns).cast("string")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), mark))
    rows, sources = plan(docs, list(weights), share, most, seed, key=key)
    cuts = (
        rows.where("before < rest and (rest - before) * 2 >= size")
        .groupBy("source", "key").agg(F.count("*").alias("n"))
        .groupBy("source").agg(F.max(F.struct("key", "n")).alias("at"))
    )
    rule = cut(
        sources.alias("s").join(cuts.alias("c"), F.expr("s.source <=> c.source"), "left").select(
            F.col("s.source").alias("__mix_source"), F.col("whole").cast("long").alias("__mix_whole"),
            F.col("at.key").alias("__mix_last"), F.col("at.n").alias("__mix_n"),
        )
    )
    if rule.count() <= BROADCAST:  # a row per source; beyond it, the join is shuffled
        rule = F.broadcast(rule)
    keyed = docs.withColumn("__mix_key", key).join(rule, F.expr("source <=> __mix_source"))

    def copies(df: DataFrame, times: Column) -> DataFrame:
        return df.where(times > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)

    before = F.coalesce((F.col("__mix_key") < F.col("__mix_last")).cast("long"), F.lit(0).cast("long"))
    at_cut = (
        keyed.where("__mix_key = __mix_last").groupBy("__mix_source", "__mix_n")
        .agg(F.first(F.struct(*docs.columns)).alias("__mix_row"))
        .select("__mix_row.*", "__mix_n")
    )
    return copies(keyed, F.col("__mix_whole") + before).unionByName(copies(at_cut, F.col("__mix_n")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
             1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total FROM r),
e AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM c),
f AS (SELECT *, ratio * open <= total - spent AS is_full FROM e),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
        (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * weight
        / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM f),
h AS (SELECT *, floor(target)::BIGINT AS budget FROM g),
i AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM h),
j AS (SELECT d.doc_id, d.size, i.source_size, i.target, i.whole, i.budget - i.whole * i.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size
                               ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM j
"""
