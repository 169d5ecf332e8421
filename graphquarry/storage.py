"""The shared folder, and tables there that cut a long lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI.

    Where none is configured, local mode sets one of its own; a cluster has to name one, since its
    executors see no folder of the driver.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), f"graphquarry-{uuid.uuid4().hex}"))
        found = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    full = str(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


#: What may be sent whole once it is measured.  A plan of many joins sends so much for each of them.
MEASURED = "1MB"


def by_measured_size(spark: SparkSession, most: str = MEASURED) -> SparkSession:
    """A session like this one, but that sends a side of a join whole only once its rows are known to be few.

    By its files' size a relation of millions of narrow rows looks small enough, and each join of it would
    bring them all to the driver; what has been shuffled is measured, and up to ``most`` of it are sent.
    A table of rows by a text or by two columns takes a page of 64 MB of the driver however few they are, so
    a plan of many joins sends none (-1).
    """
    out = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            out.conf.set(k, v)
    out.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out.conf.set("spark.sql.adaptive.enabled", "true")
    out.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into a table in the shared folder, and go on from that.

    Unlike a checkpoint, which computes its last stage twice, this writes in one pass; like one, it
    survives lost executors.  ``discard`` deletes the table.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``cut`` made, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
