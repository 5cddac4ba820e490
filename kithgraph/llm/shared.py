"""Tables in the folder that the driver and all executors share, and joins that no hot key piles up in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list of keys (8 bytes each) that may be broadcast; longer lists go through salted joins.
BROADCAST_KEYS = 500_000
#: Tasks that the rows of one key are dealt to in a salted join.
SALTS = 32


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder; only a local session without either
    takes a temporary folder, as executors elsewhere couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and it outlives lost executors."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def matched(rows: DataFrame, keys: DataFrame, key: str, deal: str, how: str = "left_semi", most: int = BROADCAST_KEYS) -> DataFrame:
    """rows joined (left_semi, left_anti, left or inner) to keys, a written table with distinct values of key.

    Up to `most` keys are broadcast, after a count.  More are joined by key and a salt from column
    `deal`, so that the rows of one key are dealt to SALTS tasks.
    """
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int"))
    spread = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [key, "__salt"], how).drop("__salt")
