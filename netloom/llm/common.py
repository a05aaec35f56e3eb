"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts have it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once for the row.

    A lambda's variable holds a value, while a reference to a column that is
    itself an expression may be inlined at every use and so computed again for
    every element of an inner lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor and the driver can reach.

    Uses ``spark.checkpoint.dir``; where that is unset (tests) a folder below the
    warehouse is used, and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/netloom-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df.checkpoint()`` with the session's reliable checkpoint folder set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared_dir(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the
    lineage, survives lost executors and keeps the columns prunable."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
