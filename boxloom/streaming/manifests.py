"""Manifests as a stream of files: the batch reader's parsing over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.schema import RECORD, sample_problem


def stream_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample records of files as they arrive, with their problem (null if sound)."""
    lines = spark.readStream.text(folder).select(F.from_json("value", RECORD).alias("record"))
    return lines.filter("record.record_type = 'sample'").select("record.sample.*", sample_problem(F.col("record.sample")).alias("problem"))
