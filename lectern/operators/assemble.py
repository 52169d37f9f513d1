"""Joins that put mails, articles and books together from the tables of their programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates, text

FROM, TO, CC = 1, 4, 5


def first_body_part(parts: DataFrame) -> DataFrame:
    """(id, body): the first part that is not blank, by part number; names that are no number are dropped."""
    p = parts.withColumn("n", F.col("part_name").try_cast("int")).where(F.col("n").isNotNull() & F.col("content").rlike(r"\S"))
    return p.groupBy("id").agg(F.min_by("content", F.struct("n", "content")).alias("body"))


def addresses(rows: DataFrame) -> DataFrame:
    """(id, sender, recipients) of rows (parent_id, kind, display_name, address, position)."""
    shown = rows.select(F.col("parent_id").alias("id"), "kind", "position", text.display_address(F.col("display_name"), F.col("address")).alias("shown"))

    def ordered(kind: int):
        got = F.collect_list(F.when(F.col("kind") == kind, F.struct("position", "shown")))
        return F.transform(F.array_sort(got), lambda x: x["shown"])

    return shown.groupBy("id").agg(F.get(ordered(FROM), F.lit(0)).alias("sender"), F.concat(ordered(TO), ordered(CC)).alias("recipients"))


def mails(items: DataFrame, folders: DataFrame, parts: DataFrame, address_rows: DataFrame, since_ticks: int = 0) -> DataFrame:
    """Mails with folder, body (or preview), sender, recipients, ISO date and id; blank ones dropped."""
    f = folders.select(F.col("id").alias("folder_id"), F.coalesce(F.nullif("path", F.lit("")), "name", F.lit("")).alias("folder"))
    m = items if not since_ticks else items.where(F.col("date") > since_ticks)
    m = m.withColumnRenamed("folder", "folder_id").join(f, "folder_id", "left").join(first_body_part(parts), "id", "left").join(addresses(address_rows), "id", "left")
    body = text.strip_signature(text.strip_quoted_replies(F.coalesce("body", "preview", F.lit(""))))
    m = m.select("id", F.coalesce("subject", F.lit("")).alias("subject"), body.alias("body"), F.coalesce("sender", F.lit("")).alias("sender"), F.coalesce("recipients", F.array().cast("array<string>")).alias("recipients"), dates.ticks_to_iso(F.col("date")).alias("date"), F.coalesce("folder", F.lit("")).alias("folder"), F.nullif("message_id", F.lit("")).alias("message_id"))
    m = m.where(F.col("body").rlike(r"\S") | F.col("subject").rlike(r"\S"))
    return m.withColumn("message_id", F.coalesce("message_id", text.fallback_message_id(F.col("sender"), F.col("subject"), F.col("date"))))


def articles(rows: DataFrame, author_rows: DataFrame, lookup: DataFrame, feeds: DataFrame, html_udf) -> DataFrame:
    """Articles with body (text, else HTML, else summary), authors and feed name; blank ones dropped."""
    a = author_rows.where("name is not null and name <> ''").join(lookup, "authorID").groupBy("articleID").agg(F.array_sort(F.collect_list("name")).alias("authors"))
    body = F.coalesce(F.nullif("contentText", F.lit("")), F.nullif(html_udf("contentHTML"), F.lit("")), F.when(F.col("summary").contains("<"), html_udf("summary")).otherwise(F.col("summary")), F.lit(""))
    seconds = dates.feed_seconds(F.col("datePublished").cast("string"))
    out = rows.join(a, "articleID", "left").join(feeds.select("feedID", F.col("name").alias("_feed"), "category"), "feedID", "left")
    out = out.select(F.col("articleID").alias("id"), F.coalesce("title", F.lit("")).alias("title"), body.alias("body"), F.coalesce(F.nullif("url", F.lit("")), "externalURL", F.lit("")).alias("url"), F.coalesce("_feed", "feedID").alias("feed_name"), F.coalesce("category", F.lit("")).alias("feed_category"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), dates.seconds_to_iso(seconds).alias("date"), seconds.alias("ts"))
    return out.where(F.col("body").rlike(r"\S") | F.col("title").rlike(r"\S"))


def books(books: DataFrame, links: dict[str, DataFrame], identifiers: DataFrame, comments: DataFrame, formats: DataFrame) -> DataFrame:
    """Books with lists by id of link: ``links`` holds (book, value) rows of authors, tags, languages, series,
    publisher, rating; the last of several identifiers or formats of one name counts."""
    out = books
    for name in ("authors", "tags", "languages"):
        got = links[name].groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))
        out = out.join(got.withColumnRenamed("book", "id"), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    for name in ("series", "publisher", "rating"):
        got = links[name].groupBy("book").agg(F.max_by("value", "pos").alias(name))
        out = out.join(got.withColumnRenamed("book", "id"), "id", "left")
    for name, rows in (("identifiers", identifiers), ("formats", formats)):
        last = rows.groupBy("book", "key").agg(F.max_by("value", "pos").alias("value"))
        got = last.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))
        out = out.join(got.withColumnRenamed("book", "id"), "id", "left")
    return out.join(comments.select(F.col("book").alias("id"), F.col("text").alias("description")), "id", "left")
