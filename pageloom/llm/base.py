"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where none is set and all work is done in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        global _own
        _own = _own or tempfile.mkdtemp(prefix="pageloom-")
        named = _own
    return named


def materialized(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read from there.

    Later passes don't compute it again, lost executors cost nothing, and the
    planner starts anew from its true size. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pageloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


_own: str | None = None

#: Bytes, in memory, of a table that may be sent to every worker; beyond, a join by shuffle is used.
SENT_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> int:
    """An upper estimate of a row's bytes in memory: fixed sizes of numbers, and 64 for anything of varying length."""
    return 24 + sum(8 if x.dataType.typeName() in ("long", "integer", "double", "boolean", "timestamp") else 64 for x in df.schema)


def sent_if_small(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its rows, counted, take at most `most` bytes; else the planner joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores: input of fewer row groups than cores, thus small, is dealt out.

    The count observed keeps filters that are worth dealing out from moving below.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores).observe(f"dealt-{uuid.uuid4().hex}", F.count(F.lit(1))) if df.rdd.getNumPartitions() < cores else df


#: Characters of texts that a worker looks at together; longer texts are looked at alone, whole.
TOGETHER = 1_000_000


def parts(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the values of column `text`, of about TOGETHER characters at most, so that memory doesn't follow the rows of a batch."""
    for batch in batches:
        values = batch.column(text).to_pylist()
        start = size = 0
        for i, v in enumerate(values):
            n = len(v or "")
            if i > start and size + n > TOGETHER:
                yield batch.slice(start, i - start), values[start:i]
                start, size = i, 0
            size += n
        if len(values) > start:
            yield batch.slice(start), values[start:]


def map_batches(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """Apply `function`, from a batch to column dicts, to each Arrow batch of `df`."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
