"""Parsers, embedding and streaming over the driver's tables: results of Python code, checked by golden tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.code import code_blocks_udf
from lectern.functions.embedding import HashEmbedder, embed, serialize_udf
from lectern.functions.parsers import html_to_text_udf, parse_markdown_udf
from lectern.plans.core_queries import register
from lectern.session import new_shared_path, table
from lectern.streaming.incremental import ingest_stream, windowed_counts


@register("html_to_text_exact")
def html_to_text_exact(spark, sf):
    return table(spark, sf, "articles").select("articleid", html_to_text_udf("contenthtml").alias("out"))


@register("frontmatter_yaml")
def frontmatter_yaml(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse_markdown_udf("content", "title").alias("note")).select("doc_id", "note.title", "note.tags", "note.links")


_CODE = ["import os", "", "", "def first(a):", "    return a", "", "", "class Box:", "    size = 1", "", "    def open(self):", "        return self.size", "", "", "def second(b):", "    return b * 2"]


@register(
    "chunk_code_ast",
    """SELECT * FROM (VALUES ('first', 'function', 4, 5), ('Box', 'class', 8, 12), ('second', 'function', 15, 16)) t(symbol, symbol_type, start_line, end_line)""",
)
def chunk_code_ast(spark, sf):
    """Python text with three definitions, whose lines are written out."""
    rows = spark.createDataFrame([("\n".join(_CODE),)], "content string")
    return rows.select(F.inline(code_blocks_udf(10, 2)("content", F.lit("python")))).where("symbol_type <> 'module_top'").select("symbol", "symbol_type", "start_line", "end_line")


@register("embed_hash")
def embed_hash(spark, sf):
    return embed(table(spark, sf, "documents").select("doc_id", "content"), HashEmbedder(64)).select("doc_id", "embedding", serialize_udf("embedding").alias("packed"))


@register("events_windowed", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_windowed(spark, sf):
    return windowed_counts(table(spark, sf, "events"), "ts", "event_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@register("stream_incremental_ingest", "SELECT * FROM events")
def stream_incremental_ingest(spark, sf):
    """The events through a file stream twice; the second run adds nothing."""
    path = new_shared_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)
        ingest_stream(source, f"{path}/sink", f"{path}/checkpoint", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{path}/sink").drop("batch")
