"""Case files: JSON arrays with validation, and their retrieval units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "chunk_id string, section_title string, text string, source_type string"
SCHEMA = f"case_id string, id string, question string, expected_section string, expected_terms array<string>, expected_positive_chunk_id string, max_expected_rank int, answer string, chunks array<struct<{UNIT.replace(' ', ':').replace(',:', ',')}>>"


def read_cases(spark: SparkSession, path: str, *, hard_negative: bool = False) -> DataFrame:
    """Cases of a file; a case that isn't valid stops the read with its name."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("case_id", F.coalesce("case_id", "id")).drop("id")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = blank("case_id") | blank("question") | (F.coalesce(F.size("chunks"), F.lit(0)) <= 0)
    bad = bad | (blank("expected_positive_chunk_id") | F.coalesce(F.col("max_expected_rank") < 1, F.lit(True)) if hard_negative else blank("expected_section"))
    return raw.withColumn("question", F.when(bad, F.raise_error(F.concat(F.lit("not a valid case: "), F.coalesce("case_id", F.lit("?"))))).otherwise(F.col("question")))


def case_units(cases: DataFrame) -> DataFrame:
    """(case_id, unit_id, page_number, section_title, text, source_type): each case's own corpus; the position is the page."""
    x = cases.select("case_id", F.posexplode("chunks").alias("at", "c"))
    return x.select("case_id", F.col("c.chunk_id").alias("unit_id"), (F.col("at") + 1).alias("page_number"), F.col("c.section_title").alias("section_title"), F.col("c.text").alias("text"), F.coalesce("c.source_type", F.lit("evaluation")).alias("source_type"))
