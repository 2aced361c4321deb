"""Tables that cut lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where neither that nor a checkpoint
    folder is set, a temporary folder is set for the session on one machine (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; runs and retries never meet in it."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: what follows
    no longer depends on the executors or shuffles that made it, so a lost
    executor costs a reread. Shuffle files of finished jobs go when the driver
    collects its garbage, so that is asked for here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_key(id_col: str, text_col: str) -> Column:
    """A key of 128 bits of hash of a row's id and text; rows equal in both have one key."""
    halves = [F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, row): every row's key and its columns as one struct, in which no name can clash with others'."""
    return docs.select(row_key(id_col, text_col).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *names: str) -> None:
    """Complain about missing columns before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark context, for where
    it isn't installed on them."""
    context = spark.sparkContext
    if context.environment.get("TESSERA_SHIPPED") != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        context.environment["TESSERA_SHIPPED"] = context.applicationId
    return spark
