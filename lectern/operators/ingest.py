"""What changed, what is new, what is stale: anti- and semi-joins by natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(files: DataFrame, sources: DataFrame, force: bool = False) -> DataFrame:
    """Files (collection_id, source_path, file_hash) that are new or have another hash."""
    if force:
        return files
    known = sources.where("file_hash is not null").select("collection_id", "source_path", "file_hash")
    return files.join(known, ["collection_id", "source_path", "file_hash"], "left_anti")


def not_indexed(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(sources.select("collection_id", "source_path"), ["collection_id", "source_path"], "left_anti")


def since_watermark(items: DataFrame, mark: str | None, date_col: str = "date", allow_late: bool = False) -> DataFrame:
    """Strictly behind the mark by text, rows without date dropped; late rows are lost unless allowed,
    when the natural key alone decides."""
    if allow_late or not mark:
        return items
    return items.where(F.col(date_col) > mark)


def classify_diff(changed: DataFrame, tracked: DataFrame, key: str = "path") -> DataFrame:
    """(path, action): what is tracked is indexed again, the rest deleted."""
    marked = changed.select(key).distinct().join(tracked.select(key, F.lit(True).alias("_t")).distinct(), key, "left")
    return marked.select(key, F.when(F.col("_t"), "index").otherwise("delete").alias("action"))


def stale_sources(sources: DataFrame, current: DataFrame, readable: bool = True, skip_uris: bool = False) -> DataFrame:
    """Sources whose path is not among the current ones; none at all if the source could not be read.
    Files are judged by path only where it is no URI, so commits stay."""
    if not readable:
        return sources.where(F.lit(False))
    mine = sources.where(~F.col("source_path").contains("://")) if skip_uris else sources
    return mine.join(current.select("source_path").distinct(), "source_path", "left_anti")


def prune_result(sources: DataFrame, stale: DataFrame, skip_uris: bool = False) -> DataFrame:
    checked = sources.where(~F.col("source_path").contains("://")) if skip_uris else sources
    a = checked.agg(F.count("*").alias("checked")).withColumn("_k", F.lit(1))
    b = stale.agg(F.count("*").alias("pruned")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").drop("_k")


def parse_watermarks(description: str | None) -> dict[str, str]:
    """Marks by repository, from JSON or from ``git:path:sha`` (the last colon parts them)."""
    import json

    if not description:
        return {}
    if description.startswith("{"):
        try:
            data = json.loads(description)
        except ValueError:
            return {}
        return data if isinstance(data, dict) and all(isinstance(v, str) for v in data.values()) else {}
    if description.startswith("git:"):
        path, colon, sha = description[4:].rpartition(":")
        return {path: sha} if colon else {}
    return {}
