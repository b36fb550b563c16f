"""What the text operators share: the two columns they read, batches of texts, and tables written on the way."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one beside the session's warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no earlier stage."""
    path = _new_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._settled_at = path
    return written


def settle_each(frames: Iterable[DataFrame]) -> DataFrame:
    """All ``frames`` (at least one, of the same columns) as one settled table; each is written before the next is asked for."""
    path = None
    for number, df in enumerate(frames):
        path = path or _new_path(df.sparkSession)
        df.write.parquet(f"{path}/written={number}")
    written = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    written._settled_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that later settled ones have replaced; nothing may read them any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._settled_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (bigint) and text of ``docs``; columns of any other name are left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of ``frames`` has in any case."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat_schema(columns: str) -> StructType:
    """A schema from ``"doc_id long, text string"``, without a session."""
    found = StructType()
    for column in columns.split(","):
        found = found.add(*column.split())
    return found


def text_at(df: DataFrame) -> int:
    """The place of the text column."""
    return [column.lower() for column in df.columns].index("text")


def map_rows(
    df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: StructType, rows_per_batch: int = 4096
) -> DataFrame:
    """``rows(*columns)`` gets the columns of an Arrow batch and yields result tuples; they leave in bounded batches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in rows(*batch.columns):
                held.append(row)
                if len(held) >= rows_per_batch:
                    yield packed(held, arrow)
                    held = []
        if held:
            yield packed(held, arrow)

    return df.mapInArrow(run, schema)


def packed(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a batch as UTF-8, one at a time; NULL is empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for text in binary:
        yield text.as_py() or b""
