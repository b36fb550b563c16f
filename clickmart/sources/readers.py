"""Readers for the six tables and the staging sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from clickmart.sources.schemas import PRIMARY_KEYS, SCHEMAS

CSV_OPTIONS = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "nullValue": "NULL"}


def read_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One table from CSV with its declared schema; empty text and the word NULL become null. A bad row is an error."""
    raw = spark.read.schema(SCHEMAS[table]).options(**CSV_OPTIONS, mode="FAILFAST").csv(path)
    return raw.withColumns(_texts_or_null(table))


def _texts_or_null(table: str) -> dict[str, Column]:
    texts = [field.name for field in SCHEMAS[table].fields if isinstance(field.dataType, StringType)]
    return {name: F.nullif(name, F.lit("")) for name in texts}


def _reason(schema: StructType, line: str) -> Column:
    """The first column whose text is there and not of its type, or else that the number of columns is wrong."""
    as_text = StructType([StructField(field.name, StringType()) for field in schema.fields])
    told = F.from_csv(line, as_text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"nullValue": "NULL"})
    wrong = [F.when(told[name].isNotNull() & (told[name] != "") & F.col(name).isNull(), F.lit(name)) for name in schema.names]
    return F.when(F.col(line).isNotNull(), F.coalesce(*wrong, F.lit("columns")))


def read_csv_checked(
    spark: SparkSession, table: str, path: str, parsed: str
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows of one table from CSV, rejected lines (line and reason: the column, or ``columns``), and how many of each.

    The file is parsed once: all rows are written to the new folder ``parsed``, from where both are read.
    """
    schema = SCHEMAS[table]
    whole = StructType([*schema.fields, StructField("line", StringType())])
    raw = spark.read.schema(whole).options(**CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord="line").csv(path)
    told = raw.withColumn("reason", _reason(schema, "line")).withColumns(_texts_or_null(table))
    seen = Observation()
    marked = told.withColumn("rejected", F.col("line").isNotNull())
    marked = marked.observe(seen, F.count_if(~F.col("rejected")).alias("rows"), F.count_if("rejected").alias("rejected"))
    marked.write.partitionBy("rejected").parquet(parsed)
    kept = StructType([*whole.fields, StructField("reason", StringType()), StructField("rejected", BooleanType())])
    rows = spark.read.schema(kept).parquet(parsed)
    return rows.where("not rejected").select(*schema.names), rows.where("rejected").select("line", "reason"), seen.get


def write_csv(df: DataFrame, table: str, path: str) -> None:
    """Store a table as CSV in the form that ``read_csv`` reads: all columns of the schema, those ``df`` lacks are null.

    Only text can tell empty from null in CSV; both are read as null.
    """
    there = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields]
    df.select(*there).write.options(**CSV_OPTIONS).csv(path)


def read_parquet(spark: SparkSession, table: str, path: str) -> DataFrame:
    """One table from parquet, selected and cast to the declared schema."""
    stored = spark.read.parquet(path)
    return stored.select([F.col(field.name).cast(field.dataType) for field in SCHEMAS[table].fields])


def read_jdbc(
    spark: SparkSession,
    table: str,
    url: str,
    *,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One table from a database, read in parallel over ranges of its primary key.

    ``lower`` and ``upper`` only set the stride; rows outside them are read by the first and last range.
    """
    stored = spark.read.jdbc(
        url,
        table,
        column=PRIMARY_KEYS[table],
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
    return stored.select([F.col(field.name).cast(field.dataType) for field in SCHEMAS[table].fields])


def read_tables(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All six tables from ``folder/<table>.<fmt>``."""
    read = {"csv": read_csv, "parquet": read_parquet}[fmt]
    return {table: read(spark, table, f"{folder}/{table}.{fmt}") for table in SCHEMAS}


def write_staging(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Store a mart or snapshot as parquet for reuse, optionally partitioned (for example by month)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
