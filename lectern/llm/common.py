"""What the corpus operators share: tables, the shared folder, and columns of results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
HUB = 1000
MOST_HUBS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and
    all work runs in this process (local tests) a temporary folder is made and set; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lectern-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: column pruning still works on it."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, computed once, with a broadcast hint if it holds at most `rows` rows; beyond that, joins are shuffled."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def hub_join(rows: DataFrame, keyed: DataFrame, key: list[str]) -> DataFrame:
    """`rows` joined with `keyed` (one row for each key, n: how many of `rows` have it; n is dropped). Keys that hold
    over 1 / MOST_HUBS of these rows, so at most MOST_HUBS keys, and over `HUB` rows, are broadcast: their rows stay
    where they are. The rest is shuffled."""
    keyed = cut(keyed)
    ends = keyed.agg(F.sum("n"), F.max("n")).first()
    limit = max(HUB, -(-int(ends[0] or 0) // MOST_HUBS))
    if (ends[1] or 0) <= limit:
        return rows.join(keyed.drop("n"), key)
    hubs = F.broadcast(keyed.where(F.col("n") > limit).drop("n"))  # MOST_HUBS rows at most
    rest = rows.join(hubs.select(*key), key, "left_anti").join(keyed.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Few rows in an Arrow batch: whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
