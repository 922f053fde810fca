"""Scans and sinks: typed tables, tagged and optional sources, nested task documents, fact tables, keyed upsert."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = "struct<column: string, properties: struct<description: string>>"
TASK = f"research_questions array<string>, data_desc struct<dataset_description: string, fields: array<{FIELD}>>"


def read_table(spark: SparkSession, path: str, label: str | None = None, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table; with ``label``, that column is called ``label`` and rows without it are dropped."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.csv(path, header=True, inferSchema=schema is None) if fmt == "csv" else reader.format(fmt).load(path)
    return df if label is None else df.withColumnRenamed(label, "label").na.drop(subset=["label"])


def read_tagged(spark: SparkSession, glob: str, pattern: str, columns: dict[str, int], schema: str) -> DataFrame:
    """All CSV files of ``glob`` with columns cut from their names by the groups of ``pattern``; rows whose status isn't ok are dropped."""
    name = F.col("_metadata.file_name")
    df = spark.read.schema(schema).csv(glob, header=True)
    df = df.select("*", *(F.regexp_extract(name, pattern, g).alias(c) for c, g in columns.items()))
    return df.filter("status = 'ok'") if "status" in df.columns else df


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_optional(spark: SparkSession, paths: dict[str, str], schema: str, fmt: str = "parquet") -> DataFrame:
    """The union of the sources that exist, each tagged with its experiment; none gives an empty table of the schema."""
    found = [read_table(spark, p, fmt=fmt, schema=schema).withColumn("experiment", F.lit(tag)) for tag, p in paths.items() if exists(spark, p)]
    out = spark.createDataFrame([], T._parse_datatype_string(f"{schema}, experiment string"))
    for df in found:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_task_docs(spark: SparkSession, path: str, fields: int = 10) -> DataFrame:
    """First question, description and the first fields of task documents (one JSON object per file)."""
    df = spark.read.schema(TASK).json(path, multiLine=True)
    shown = F.transform(F.slice("data_desc.fields", 1, fields), lambda f: F.concat_ws(": ", f["column"], f["properties"]["description"]))
    return df.select(F.try_element_at("research_questions", F.lit(1)).alias("question"), F.col("data_desc.dataset_description").alias("description"), F.concat_ws("; ", shown).alias("fields"))


def write_facts(df: DataFrame, path: str, columns: list[str], fmt: str = "csv") -> None:
    writer = df.select(*columns).write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` without the rows whose key is in ``new``, and ``new``."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def pending_pairs(grid: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["model", "dataset"]
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint(df: DataFrame, settings: dict | None = None) -> str:
    """What work on ``df`` with ``settings`` is known by: equal for equal rows in any order, in any number of partitions.

    Number, sum and exclusive or of the rows' hashes, with names and types of the columns, in one pass.
    """
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    # Nulls leave a hash as it is, so which ones there are goes into it too.
    gaps = F.concat(F.lit(""), *(F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns))
    row = df.select(F.xxhash64(whole, gaps).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    said = json.dumps([df.schema.simpleString(), row.n, str(row.s), row.x, settings or {}], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()


def once(spark: SparkSession, path: str, inputs: DataFrame, settings: dict, work) -> DataFrame:
    """``work()``, stored under ``path`` by the fingerprint of its inputs and settings: done again where those are new only."""
    place = f"{path.rstrip('/')}/inputs={fingerprint(inputs, settings)}"
    if not exists(spark, f"{place}/_SUCCESS"):
        work().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
