"""Written stages: what several later steps read is computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written and not deleted, by application: folder and table name.
_WRITTEN: dict[str, list[tuple[str, str]]] = {}


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one is set for the session on one machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, by: str | None = None, dealt: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back. Later plans start from the table: nothing is computed twice,
    plans stay small enough to be analysed quickly, and a lost executor costs a reread.

    by: rows are dealt to as many buckets as there are shuffle partitions by this column, so that windows, aggregates and joins
    by it need no exchange when they read the table. dealt: the last steps of `df` are windows or joins by that column already, so
    its tasks write their own buckets; otherwise rows are dealt out first. So that joins by this and further columns
    (asset and date) keep the dealing, the session's spark.sql.requireAllClusterKeysForCoPartition is set to false.
    unstage() or release_stages() delete a table."""
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex[:12]}".replace("-", "_")
    path = f"{_folder(spark)}/tessera/{spark.sparkContext.applicationId}/{table}"
    if by is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        (df if dealt else df.repartition(n, by)).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(table)
        out = spark.table(table)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append((path, table if by else ""))
    out._tessera_stage = path
    return out


def is_stage(df: DataFrame) -> bool:
    """Whether `df` is a table just as stage() wrote it."""
    return getattr(df, "_tessera_stage", None) is not None


def _delete(spark: SparkSession, path: str, table: str) -> None:
    if table:
        spark.sql(f"drop table if exists {table}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstage(df: DataFrame) -> None:
    """Delete a table that stage() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_tessera_stage", None)
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for entry in [w for w in written if w[0] == path]:
        written.remove(entry)
        _delete(spark, *entry)


def release_stages(spark: SparkSession) -> int:
    """Delete all tables that stage() has written for this application, when its results are done with; how many they were."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path, table in written:
        _delete(spark, path, table)
    return len(written)
