"""Catalogue, maintenance, ingestion and assembly queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lectern.operators import assemble, catalog, ingest
from lectern.plans.core_queries import register
from lectern.session import table


def store(spark, sf) -> catalog.Store:
    return catalog.Store(table(spark, sf, "collections"), table(spark, sf, "sources"), table(spark, sf, "documents"), table(spark, sf, "vec_documents"))


@register(
    "collection_stats",
    """SELECT c.collection_name, c.collection_type, (SELECT count(*) FROM sources s WHERE s.collection_id = c.id) AS source_count,
       (SELECT count(*) FROM documents d WHERE d.collection_id = c.id) AS chunk_count,
       strftime((SELECT max(last_indexed_at) FROM sources s WHERE s.collection_id = c.id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_indexed FROM collections c""",
)
def collection_stats(spark, sf):
    return catalog.collection_stats(store(spark, sf)).withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))


@register(
    "collection_info",
    """SELECT c.collection_name, (SELECT count(*) FROM sources WHERE collection_id = c.id) AS sources, (SELECT count(*) FROM documents WHERE collection_id = c.id) AS chunks,
       strftime((SELECT max(last_indexed_at) FROM sources WHERE collection_id = c.id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_indexed,
       (SELECT string_agg(source_type || '=' || n, '; ' ORDER BY source_type) FROM (SELECT source_type, count(*) AS n FROM sources WHERE collection_id = c.id GROUP BY source_type)) AS kinds
       FROM collections c WHERE c.id = 3""",
)
def collection_info(spark, sf):
    s = store(spark, sf)
    one = s.collections.where("id = 3").select("collection_name")
    stats = catalog.collection_stats(s).join(one, "collection_name").select("collection_name", F.col("source_count").alias("sources"), F.col("chunk_count").alias("chunks"), F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss").alias("last_indexed"))
    kinds = catalog.source_type_breakdown(s, 3).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_type", "n"))), "; ").alias("kinds"))
    return stats.withColumn("k", F.lit(1)).join(kinds.withColumn("k", F.lit(1)), "k").drop("k")


@register("source_type_breakdown", "SELECT source_type, count(*) AS n FROM sources GROUP BY source_type")
def source_type_breakdown(spark, sf):
    return catalog.source_type_breakdown(store(spark, sf))


@register("sample_titles", "SELECT DISTINCT title FROM documents WHERE collection_id = 2 AND title IS NOT NULL ORDER BY title LIMIT 10")
def sample_titles(spark, sf):
    return catalog.sample_titles(store(spark, sf), 2, 10)


@register("status_overview", "SELECT (SELECT count(*) FROM collections) AS collections, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM documents) AS chunks, (SELECT strftime(max(last_indexed_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') FROM sources) AS last_indexed")
def status_overview(spark, sf):
    return catalog.status(store(spark, sf)).withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))


@register("watermark_max_date", "SELECT event_type, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS watermark FROM events GROUP BY event_type")
def watermark_max_date(spark, sf):
    """The operator over documents made of events, a collection for each type."""
    e = table(spark, sf, "events").select(F.xxhash64("event_type").alias("collection_id"), "event_type", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))).alias("metadata"))
    marks = catalog.watermark(replace(store(spark, sf), documents=e))
    return marks.join(e.select("collection_id", "event_type").distinct(), "collection_id").select("event_type", "watermark")


@register("incremental_since", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') > '2024-01-10T00:00:00Z'")
def incremental_since(spark, sf):
    e = table(spark, sf, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return ingest.since_watermark(e, "2024-01-10T00:00:00Z").select("event_id")


@register("dedup_natural_key", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_natural_key(spark, sf):
    """New natural keys once, by the upsert of sources: users stand for collections, types for paths."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("collection_id"), F.col("event_type").alias("source_path"))
    none = spark.createDataFrame([], "id long, collection_id long, source_path string")
    return catalog.upsert_sources(none, e).select(F.col("collection_id").alias("user_id"), F.col("source_path").alias("event_type"))


_FILES = "SELECT collection_id, source_path, CASE WHEN file_modified_at > '2020' THEN sha256(source_path) ELSE file_hash END AS file_hash FROM sources WHERE file_hash IS NOT NULL"


@register("changed_files_antijoin", f"SELECT f.* FROM ({_FILES}) f WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.collection_id = f.collection_id AND s.source_path = f.source_path AND s.file_hash = f.file_hash)")
def changed_files_antijoin(spark, sf):
    s = table(spark, sf, "sources")
    files = s.where("file_hash is not null").select("collection_id", "source_path", F.when(F.col("file_modified_at") > "2020", F.sha2("source_path", 256)).otherwise(F.col("file_hash")).alias("file_hash"))
    return ingest.changed_files(files, s)


@register("exists_check_antijoin", "SELECT 'email://' || m.message_id AS source_path FROM email_messages m WHERE m.message_id IS NOT NULL AND ('email://' || m.message_id) NOT IN (SELECT source_path FROM sources)")
def exists_check_antijoin(spark, sf):
    m = table(spark, sf, "email_messages").where("message_id is not null").select(F.lit(2).cast("long").alias("collection_id"), F.concat(F.lit("email://"), "message_id").alias("source_path"))
    return ingest.not_indexed(m, table(spark, sf, "sources")).select("source_path")


@register("stale_sources_antijoin", "SELECT id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source_id = s.id)")
def stale_sources_antijoin(spark, sf):
    s = table(spark, sf, "sources")
    alive = s.join(table(spark, sf, "documents").select(F.col("source_id").alias("id")), "id", "left_semi")
    return ingest.stale_sources(s, alive).select("id")


@register("diff_classify", "SELECT DISTINCT source_path AS path, CASE WHEN file_modified_at > '2020' THEN 'index' ELSE 'delete' END AS action FROM sources WHERE source_type = 'markdown'")
def diff_classify(spark, sf):
    s = table(spark, sf, "sources").where("source_type = 'markdown'").select("file_modified_at", F.col("source_path").alias("path"))
    return ingest.classify_diff(s, s.where("file_modified_at > '2020'"))


@register("prune_result", "SELECT (SELECT count(*) FROM sources WHERE NOT contains(source_path, '://')) AS checked, (SELECT count(*) FROM sources WHERE NOT contains(source_path, '://') AND coalesce(file_modified_at, '') <= '2012') AS pruned")
def prune_result(spark, sf):
    s = table(spark, sf, "sources")
    stale = ingest.stale_sources(s, s.where("file_modified_at > '2012'"), skip_uris=True)
    return ingest.prune_result(s, stale, skip_uris=True)


@register("delete_collection", """SELECT (SELECT count(*) FROM sources WHERE collection_id <> 3) AS sources, (SELECT count(*) FROM documents WHERE collection_id <> 3) AS documents,
  (SELECT count(*) FROM vec_documents v WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN sources s ON s.id = d.source_id WHERE d.doc_id = v.document_id AND s.collection_id = 3)) AS vectors""")
def delete_collection(spark, sf):
    left = catalog.delete_collection(store(spark, sf), "rss")
    parts = [x.agg(F.count("*").alias(n)).withColumn("k", F.lit(1)) for n, x in (("sources", left.sources), ("documents", left.documents), ("vectors", left.vectors))]
    return parts[0].join(parts[1], "k").join(parts[2], "k").drop("k")


@register("orphan_vectors", "SELECT vec_rowid FROM vec_documents v WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = v.document_id)")
def orphan_vectors(spark, sf):
    return catalog.orphans(store(spark, sf)).select("vec_rowid")


@register(
    "vector_parity",
    """SELECT v.vec_rowid, CASE WHEN b.embedding IS NULL THEN 'missing' ELSE 'stale' END AS state FROM (
       SELECT vec_rowid, array_to_string(list_transform(range(0, 8), lambda k: printf('%02X', CAST(list_sum(list_transform(range(0, 8), lambda i:
         CASE WHEN embedding[k * 8 + i + 1] > 0 AND NOT isnan(embedding[k * 8 + i + 1]) THEN 1 << i::INT ELSE 0 END)) AS INT))), '') AS h
       FROM vec_documents WHERE len(embedding) = 64) v LEFT JOIN vec_documents_bin b ON b.vec_rowid = v.vec_rowid WHERE b.embedding IS NULL OR hex(b.embedding) <> v.h""",
)
def vector_parity(spark, sf):
    return catalog.vector_parity(table(spark, sf, "vec_documents"), table(spark, sf, "vec_documents_bin"))


@register("rewrite_source_paths", "SELECT id, CASE WHEN starts_with(source_path, '/data/vault') THEN '/mnt/notes' || substring(source_path, 12) ELSE source_path END AS source_path FROM sources")
def rewrite_source_paths(spark, sf):
    return catalog.rewrite_paths(table(spark, sf, "sources"), "/data/vault", "/mnt/notes").select("id", "source_path")


@register("export_collection", """SELECT id, '{"id":' || id || ',"source_type":"' || source_type || '","source_path":"' || source_path || '"' || coalesce(',"file_hash":"' || file_hash || '"', '') || coalesce(',"file_modified_at":"' || file_modified_at || '"', '') || '}' AS source FROM sources WHERE collection_id = 1""")
def export_collection(spark, sf):
    return catalog.export_collection(store(spark, sf), "obsidian")


@register("index_result_merge", "SELECT sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS indexed, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS skipped, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, count(*) AS total_found, (SELECT string_agg(m, '; ' ORDER BY m) FROM (SELECT event_type || ' ' || lpad(event_id::VARCHAR, 12, '0') AS m FROM events ORDER BY m LIMIT 10)) AS messages FROM events")
def index_result_merge(spark, sf):
    flag = lambda t: F.when(F.col("event_type") == t, 1).otherwise(0)
    rows = table(spark, sf, "events").select(flag("click").alias("indexed"), flag("view").alias("skipped"), flag("error").alias("errors"), F.lit(1).alias("total_found"), F.array(F.concat_ws(" ", "event_type", F.lpad(F.col("event_id").cast("string"), 12, "0"))).alias("messages"))
    return catalog.result_merge(rows).withColumn("messages", F.array_join("messages", "; "))


@register("mail_first_body_part", "SELECT o_custkey AS id, first(o_orderpriority ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey")
def mail_first_body_part(spark, sf):
    parts = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("part_name"), F.col("o_orderpriority").alias("content"))
    return assemble.first_body_part(parts)


@register("mail_recipients_collect", """SELECT mail_id, string_agg(r, '; ' ORDER BY pos) AS recipients FROM (SELECT mail_id, unnest(recipients) AS r, generate_subscripts(recipients, 1) AS pos FROM email_messages) GROUP BY mail_id""")
def mail_recipients_collect(spark, sf):
    rows = table(spark, sf, "email_messages").select(F.col("mail_id").alias("parent_id"), F.posexplode("recipients").alias("position", "address"))
    rows = rows.withColumn("kind", F.lit(assemble.TO)).withColumn("display_name", F.lit(""))
    return assemble.addresses(rows).select(F.col("id").alias("mail_id"), F.array_join("recipients", "; ").alias("recipients"))


@register("book_authors_collect", "SELECT l_orderkey, string_agg(p_brand, '; ' ORDER BY l_linenumber, p_brand) AS authors FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def book_authors_collect(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    authors = rows.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("pos"), F.col("p_brand").alias("value"))
    got = _books(spark, rows.select(F.col("l_orderkey").alias("id")).distinct(), authors=authors)
    return got.select(F.col("id").alias("l_orderkey"), F.array_join("authors", "; ").alias("authors"))


@register("book_identifiers_map", "SELECT id, string_agg(k || '=' || v, '; ' ORDER BY k) AS identifiers FROM (SELECT l_orderkey AS id, l_returnflag AS k, max(l_suppkey)::VARCHAR AS v FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY id")
def book_identifiers_map(spark, sf):
    l = table(spark, sf, "lineitem")
    ids = l.select(F.col("l_orderkey").alias("book"), F.col("l_returnflag").alias("key"), F.col("l_suppkey").cast("string").alias("value"), F.col("l_suppkey").alias("pos"))
    got = _books(spark, l.select(F.col("l_orderkey").alias("id")).distinct(), identifiers=ids)
    return got.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("identifiers"))


def _books(spark, ids, authors=None, identifiers=None):
    """The operator with what a query has, the other tables being empty."""
    none = spark.createDataFrame([], "book long, pos long, value string")
    pairs = spark.createDataFrame([], "book long, key string, value string, pos long")
    links = {name: none for name in ("authors", "tags", "languages", "series", "publisher", "rating")} | ({"authors": authors} if authors is not None else {})
    return assemble.books(ids, links, identifiers if identifiers is not None else pairs, spark.createDataFrame([], "book long, text string"), pairs)
