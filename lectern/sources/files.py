"""Files as rows: scanned, hashed and read by Spark's binary file source, in parallel."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths


def _below(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, relative, modificationTime, content) of all files below a folder, or of one file."""
    root = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.url_decode(F.replace(F.regexp_replace("path", r"^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
    relative = F.when(F.col("source_path").startswith(root + "/"), F.substr("source_path", F.lit(len(root) + 2))).otherwise(F.substring_index("source_path", "/", -1))
    return rows.select(plain.alias("source_path"), "modificationTime", "content").withColumn("relative", relative)


def _known(rows: DataFrame) -> DataFrame:
    kind = paths.source_type(F.col("source_path"))
    return rows.where(kind != "").select(
        "source_path", kind.alias("source_type"), F.sha2("content", 256).alias("file_hash"), F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("file_modified_at"), "content"
    )


def _all_below(spark: SparkSession, roots: list[str]) -> DataFrame:
    rows = spark.createDataFrame([], "source_path string, modificationTime timestamp, content binary, relative string")
    for root in roots:
        if os.path.exists(root):
            rows = rows.unionByName(_below(spark, root))
    return rows


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(source_path, source_type, file_hash, file_modified_at, content) of known, visible files below the roots,
    whatever lies above them; roots that don't exist are skipped, files are taken as they are."""
    return _known(_all_below(spark, roots).where(~paths.is_hidden(F.col("relative"))))


def scan_vaults(spark: SparkSession, vaults: list[str], exclude: list[str] | None = None) -> DataFrame:
    """The same for the notes of vaults, without hidden and excluded folders below them."""
    roots = [os.path.abspath(os.path.expanduser(v)) for v in vaults]
    return _known(_all_below(spark, roots).where(~paths.skipped_in_vault(F.col("relative"), exclude)))
