"""Parquet tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, in memory, of a table that may be sent to every worker; beyond, a join by shuffle is used.
SENT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent_if_small(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its rows, counted, take at most `most` bytes (64 for anything of varying length); else the planner joins by shuffle."""
    row = 24 + sum(8 if x.dataType.typeName() in ("long", "integer", "double", "boolean", "timestamp") else 64 for x in df.schema)
    return F.broadcast(df) if df.count() * row <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores: input of fewer row groups than cores, thus small, is dealt out.

    The count observed keeps filters that are worth dealing out from moving below.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores).observe(f"dealt-{uuid.uuid4().hex}", F.count(F.lit(1))) if df.rdd.getNumPartitions() < cores else df


#: Whether the later copies of a folder's pages may be sent, counted once an application.
_few: dict[tuple[str, str], bool] = {}


def later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, at): where in the files the second and further copies of pages delivered more than once stand; found by ids alone."""
    ids = table(spark, sf_dir, "document_page").select("page_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    first = ids.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("file", "at")).alias("first")).where("n > 1")
    return ids.join(first, ids["page_id"].eqNullSafe(first["id"])).where(F.struct("file", "at") != F.col("first")).select("file", "at")


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per page: a page delivered twice counts once.

    Only ids are shuffled to find the copies, which are then left out by their places; texts stay where they are read.
    """
    own = ("page_id", "source_id", "page_number", *columns)
    t = spread(table(spark, sf_dir, "document_page").select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")))
    later = later_copies(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _few:
        _few[key] = later.count() * 96 <= SENT_BYTES
    later = F.broadcast(later) if _few[key] else later
    return t.join(later, (t["_file"] == later["file"]) & (t["_at"] == later["at"]), "left_anti").select(*own)
