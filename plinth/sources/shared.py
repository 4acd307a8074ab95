"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; only a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plinth-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: for results that several plans use, cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a counted table is sent to all tasks.
SENT_BYTES = 32 << 20


def sent(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """df, marked for sending where its rows, counted in bytes, allow it; else for a merge, as Spark would judge it by its compressed files."""
    n = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df.hint("merge")


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; results that still read it are lost."""
    system, path = fs.FileSystem.from_uri(shared_folder(spark))
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)
