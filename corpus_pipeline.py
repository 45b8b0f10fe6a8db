"""The corpus pipeline: each stage works on all that the stage before it kept.

1. toxicity: documents predicted toxic go.
2. near_duplicates: of every class of near copies one document stays.
3. decontamination: documents that hold a benchmark item, also a re-parameterised one, go.
4. mixture: every source gives documents up to its target, in hash-random order, repeated if need be.
5. shards: documents get a shard and a slot in it along a Hilbert curve.

Defined results: the stages' rows with nulls, empty or very long texts, ties, repeated rows and empty tables are
those of their operators, as each function states; columns besides doc_id, text, lang and source pass through the first
four stages untouched whatever their names are, but for names that start with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontam, minhash, mixing, sharding, toxicity
from lectern.llm.common import fresh_dir, table

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under 0.5. Null and empty texts have the score of the bias; repeated rows are scored each; without
    labels of both classes every row has the same score; an empty table stays empty."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the smallest doc_id (ties of texts included). Null, empty and wordless texts are one
    class; rows with a null doc_id stay all; of a repeated doc_id each different text stays once."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Null and empty texts hold none and stay; repeated rows and rows of one
    doc_id are judged each by its text; an empty benchmark leaves all."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. A null source is a source of its own; texts without words are taken with their
    source's whole epochs and with the cut's prefix; equal rows stand for each other; an empty table stays empty."""
    return mixing.apply_mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and slot for each row. Nulls of a dimension sort last; equal rows get places of their own; fewer rows than
    shards leave shards empty; an empty table gives no rows."""
    return sharding.shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("shards", deal_shards),
]

# A classifier, signatures and template windows: not expressible in SQL; tests hold the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
