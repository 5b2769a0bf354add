"""Write mode of plain SQL: tables made and filled by queries, and results copied out to files."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.operators.landing import shared_folder


def working_table(spark: SparkSession, name: str) -> str:
    """A fresh table name in a database that lies in the shared folder; dropping the table drops its files."""
    folder = shared_folder(spark)
    base = f"gauge_tables_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} LOCATION '{folder}/{base}'")
    return f"{base}.{name}_{uuid.uuid4().hex}"


def create_table_as(spark: SparkSession, table: str, select: str, **frames: DataFrame) -> DataFrame:
    """``CREATE TABLE … AS``; ``{name}`` in the query stands for the frame of that name."""
    spark.sql(f"CREATE TABLE {table} USING parquet AS {select}", **frames)
    return spark.table(table)


def insert_into(spark: SparkSession, table: str, select: str, **frames: DataFrame) -> DataFrame:
    """Appends a query's rows, by column position; an error leaves the table as it was."""
    spark.sql(f"INSERT INTO {table} {select}", **frames)
    return spark.table(table)


def copy_to(spark: SparkSession, folder: str, kind: str, select: str, **frames: DataFrame) -> None:
    """A query's rows as files of ``kind`` in ``folder``, replacing what is there."""
    spark.sql(f"INSERT OVERWRITE DIRECTORY '{folder}' USING {kind} {select}", **frames)
