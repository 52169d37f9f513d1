"""Statistics and maintenance of the catalogue: collections, sources, documents, vectors.

Changes are anti-joins that give the new state of a table; a caller writes it beside
the old one and swaps, as plain Parquet has no MERGE.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.vector import sign_bits
from lectern.session import with_fields


@dataclass(frozen=True)
class Store:
    """The four tables; ids as in ``sources.id``, ``documents.doc_id``."""

    collections: DataFrame
    sources: DataFrame
    documents: DataFrame
    vectors: DataFrame


def collection_stats(store: Store) -> DataFrame:
    """Per collection its sources, chunks and last indexing; each fact table is aggregated before the join."""
    s = store.sources.groupBy("collection_id").agg(F.count("*").alias("source_count"), F.max("last_indexed_at").alias("last_indexed"))
    d = store.documents.groupBy("collection_id").agg(F.count("*").alias("chunk_count"))
    c = store.collections.select(F.col("id").alias("collection_id"), "collection_name", "collection_type")
    out = c.join(s, "collection_id", "left").join(d, "collection_id", "left")
    return out.select("collection_name", "collection_type", F.coalesce("source_count", F.lit(0)).alias("source_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "last_indexed")


def source_type_breakdown(store: Store, collection_id: int | None = None) -> DataFrame:
    s = store.sources if collection_id is None else store.sources.where(F.col("collection_id") == collection_id)
    return s.groupBy("source_type").agg(F.count("*").alias("n"))


def sample_titles(store: Store, collection_id: int, n: int) -> DataFrame:
    """The first titles in order; a report, so the cut is its purpose."""
    return store.documents.where((F.col("collection_id") == collection_id) & F.col("title").isNotNull()).select("title").distinct().orderBy("title").limit(n)


def status(store: Store) -> DataFrame:
    """One row: counts of all tables and the last indexing."""
    a = store.collections.agg(F.count("*").alias("collections"))
    b = store.sources.agg(F.count("*").alias("sources"), F.max("last_indexed_at").alias("last_indexed"))
    c = store.documents.agg(F.count("*").alias("chunks"))
    one = [x.withColumn("_k", F.lit(1)) for x in (a, b, c)]
    return reduce(lambda x, y: x.join(y, "_k"), one).drop("_k")


def watermark(store: Store, collection_id: int | None = None) -> DataFrame:
    """Per collection the greatest date in the metadata, compared as text."""
    d = store.documents if collection_id is None else store.documents.where(F.col("collection_id") == collection_id)
    return d.groupBy("collection_id").agg(F.max(F.get_json_object("metadata", "$.date")).alias("watermark"))


def vector_parity(vectors: DataFrame, bits: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_rowid, state): bits that are missing or differ from the vector's signs."""
    mine = vectors.select("vec_rowid", sign_bits("embedding", dim).alias("want")).where("want is not null")
    both = mine.join(bits.select("vec_rowid", F.col("embedding").alias("have")), "vec_rowid", "left")
    return both.select("vec_rowid", F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "stale").alias("state")).where("state is not null")


def backfill_bits(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """The bits of all vectors of that length, made anew."""
    return vectors.select("vec_rowid", "document_id", sign_bits("embedding", dim).alias("embedding")).where("embedding is not null")


def delete_sources(store: Store, gone: DataFrame) -> Store:
    """The store without the sources whose ``id`` is in ``gone``; their documents and vectors go with them.
    Vectors whose document never existed stay: nothing names them."""
    ids = gone.select(F.col("id").alias("source_id"))
    docs_gone = store.documents.join(ids, "source_id", "left_semi").select(F.col("doc_id").alias("document_id"))
    return Store(
        store.collections,
        store.sources.join(gone.select("id"), "id", "left_anti"),
        store.documents.join(ids, "source_id", "left_anti"),
        store.vectors.join(docs_gone, "document_id", "left_anti"),
    )


def delete_collection(store: Store, name: str) -> Store:
    coll = store.collections.where(F.col("collection_name") == name).select(F.col("id").alias("collection_id"))
    out = delete_sources(store, store.sources.join(coll, "collection_id", "left_semi").select("id"))
    return Store(out.collections.where(F.col("collection_name") != name), out.sources, out.documents, out.vectors)


def orphans(store: Store) -> DataFrame:
    """Vectors without a document."""
    return store.vectors.join(store.documents.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")


def rewrite_paths(sources: DataFrame, old: str, new: str, where: Column | None = None) -> DataFrame:
    """Paths that start with ``old``, letter for letter, start with ``new`` instead."""
    hit = F.col("source_path").startswith(old)
    hit = hit if where is None else hit & where
    return sources.withColumn("source_path", F.when(hit, F.concat(F.lit(new), F.substr("source_path", F.lit(len(old) + 1)))).otherwise(F.col("source_path")))


def export_collection(store: Store, name: str) -> DataFrame:
    """One JSON object per source; fields without value are left out."""
    c = store.collections.where(F.col("collection_name") == name).select(F.col("id").alias("collection_id"))
    s = store.sources.join(c, "collection_id", "left_semi")
    fields = F.struct("id", "source_type", "source_path", F.nullif("file_hash", F.lit("")).alias("file_hash"), F.nullif("file_modified_at", F.lit("")).alias("file_modified_at"))
    return s.select("id", F.to_json(fields).alias("source"))


def upsert_sources(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` replaces rows of its (collection_id, source_path), keeping their ids; new paths get ids
    above the greatest one, in the order of collection and path."""
    key = ["collection_id", "source_path"]
    latest = changed.dropDuplicates(key)
    known = latest.join(sources.select("id", *key), key, "left")
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    old = known.where("id is not null")
    fresh = known.where("id is null").drop("id")
    # zipWithIndex numbers without gathering the rows in one task
    schema = with_fields(fresh.schema, id=T.LongType())
    numbered = fresh.orderBy(*key).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1 + top)).toDF(schema)
    return sources.join(latest.select(*key), key, "left_anti").select(*sources.columns).unionByName(old.select(*sources.columns)).unionByName(numbered.select(*sources.columns))


def result_merge(results: DataFrame) -> DataFrame:
    """Sum of index results; the ten least messages are kept, so no task ever holds more than ten a partition."""
    total = results.agg(*[F.sum(c).alias(c) for c in ("indexed", "skipped", "errors", "total_found")]).withColumn("k", F.lit(1))
    first = results.select(F.explode("messages").alias("m")).orderBy("m").limit(10).agg(F.array_sort(F.collect_list("m")).alias("messages")).withColumn("k", F.lit(1))
    return total.join(first, "k").drop("k")
