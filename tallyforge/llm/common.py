"""Helpers of the training-data operators: input tables and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine, as in tests, a folder
    of its own is made, one per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tallyforge-")
    return _own_folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    This cuts the lineage: a lost executor costs no more than reading the files
    again. Each call writes to a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tallyforge/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
