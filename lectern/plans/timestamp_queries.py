"""Instants of mails, articles and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.timestamps import to_instant
from lectern.plans.core_queries import register
from lectern.session import table

KINDS = (
    ("email", "email_messages", "mail_id", "sent_date", "account"),
    ("article", "articles", "articleid", "datepublished", "feedid"),
    ("book", "calibre_books", "id", "pubdate", "library"),
)


def _all_instants(spark, sf):
    zones, out = table(spark, sf, "home_zones"), None
    for kind, name, key, value, origin in KINDS:
        rows = table(spark, sf, name).select(F.lit(kind).alias("record_kind"), F.col(key).cast("string").alias("record_id"), F.col(value).alias("written"), F.col(origin).cast("string").alias("origin"))
        out = rows if out is None else out.unionByName(rows)
    return to_instant(out, zones, "written", "origin")


@register("p2_found")
def p2_found(spark, sf):
    return _all_instants(spark, sf).where("utc_second is not null").select("record_kind", "record_id", "utc_second")


@register("p2_normalised")
def p2_normalised(spark, sf):
    """Every record with what it said and its instant as a UTC timestamp, or null."""
    return _all_instants(spark, sf).withColumn("instant", F.timestamp_seconds("utc_second"))
