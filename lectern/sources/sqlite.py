"""SQLite tables through Python's data source API: ``spark.read.format("sqlite")``.

Options: ``path``, ``table``, ``partitions`` (ranges of rowid, read in parallel),
``columns`` (a JSON list: no others are read) and ``where`` (SQL that the file's engine
evaluates, so rows that don't pass never reach Spark).
The file is opened read-only and must be where the tasks run.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: the general form of a UUID.
UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _spark_type(declared: str) -> str:
    d = (declared or "").upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "binary" if "BLOB" in d else "string"


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, names: list[str], kinds: list[str], where: str = ""):
        self.path, self.table, self.parts, self.names, self.kinds, self.where = path, table, parts, names, kinds, where

    def partitions(self):
        with connect(self.path) as con:
            try:
                lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # no rowid
                return [InputPartition(None)]
        if lo is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [InputPartition((a, min(a + step - 1, hi))) for a in range(lo, hi + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        cast = {"bigint": int, "double": float, "string": str, "binary": bytes}
        cols = ", ".join(f'"{n}"' for n in self.names)
        tests, args = ([], ()) if partition.value is None else (["rowid BETWEEN ? AND ?"], partition.value)
        tests += [f"({self.where})"] if self.where else []
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        con = connect(self.path)
        try:
            for row in con.execute(f'SELECT {cols} FROM "{self.table}"{where}', args):
                yield tuple(None if v is None else v if isinstance(v, bytes) and k == "binary" else self._fit(v, cast[k]) for v, k in zip(row, self.kinds))
        finally:
            con.close()

    @staticmethod
    def _fit(v, kind):
        try:
            return kind(v)
        except (TypeError, ValueError):
            return None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        with connect(self.options["path"]) as con:
            got = [(r[1], _spark_type(r[2])) for r in con.execute(f'PRAGMA table_info("{self.options["table"]}")')]
        if not got:
            raise ValueError(f"no table {self.options['table']!r}")
        wanted = json.loads(self.options.get("columns", "null"))
        if wanted is None:
            return got
        kinds = dict(got)
        if missing := [n for n in wanted if n not in kinds]:
            raise ValueError(f"no columns {missing} in {self.options['table']!r}")
        return [(n, kinds[n]) for n in wanted]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema) -> DataSourceReader:
        cols = self._columns()
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("partitions", "8")), [n for n, _ in cols], [k for _, k in cols], self.options.get("where", ""))


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: list[str] | None = None, where: str = "") -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).option("columns", json.dumps(columns)).option("where", where).load()


def mail_accounts(base: str) -> list[str]:
    """Folders of two nested UUID names that hold a mail index; the base itself may be one."""
    if os.path.exists(os.path.join(base, "mail_index.dat")):
        return [base]
    found = []
    for a in sorted(os.listdir(base)) if os.path.isdir(base) else []:
        for b in sorted(os.listdir(os.path.join(base, a))) if UUID.match(a) and os.path.isdir(os.path.join(base, a)) else []:
            if UUID.match(b) and os.path.exists(os.path.join(base, a, b, "mail_index.dat")):
                found.append(os.path.join(base, a, b))
    return found


def feed_accounts(base: str) -> list[str]:
    return sorted(os.path.dirname(p) for p in glob.glob(os.path.join(base, "*", "DB.sqlite3")))


def read_mails(spark: SparkSession, account: str, since_ticks: int = 0) -> DataFrame:
    """Mails of an account; unreadable folders, bodies or addresses count as empty."""
    from lectern.operators import assemble

    def soft(file: str, table: str, schema: str, columns: list[str]) -> DataFrame:
        path = os.path.join(account, file)
        try:
            return read_table(spark, path, table).selectExpr(*columns)
        except Exception:
            return spark.createDataFrame([], schema)

    items = read_table(spark, os.path.join(account, "mail_index.dat"), "MailItems", columns=["id", "folder", "date", "subject", "messageId", "preview"], where=f"date > {int(since_ticks)}" if since_ticks else "").selectExpr("id", "folder", "date", "subject", "messageId as message_id", "preview")
    folders = soft("folders.dat", "Folders", "id long, path string, name string", ["id", "path", "name"])
    parts = soft("mail_fti.dat", "LocalMailsIndex3", "id long, part_name string, content string", ["id", "cast(partName as string) as part_name", "content"])
    rows = soft("mail_index.dat", "MailAddresses", "parent_id long, kind long, display_name string, address string, position long", ["parentId as parent_id", "type as kind", "displayName as display_name", "address", "position"])
    return assemble.mails(items, folders, parts, rows, since_ticks)


def feed_metadata(account: str) -> tuple[dict[str, str], dict[str, str]]:
    """(name, category) by feed id, from the subscriptions and the property list."""
    import plistlib
    from urllib.parse import urlparse
    from xml.etree import ElementTree

    names, categories = {}, {}
    try:
        outline = ElementTree.parse(os.path.join(account, "Subscriptions.opml")).getroot().find("body")
        for node in [x for o in outline for x in (o, *o)]:
            url = node.get("xmlUrl")
            if url:
                names[url] = node.get("text") or node.get("title") or urlparse(url).netloc
    except (OSError, ElementTree.ParseError, TypeError):
        pass
    try:
        with open(os.path.join(account, "FeedMetadata.plist"), "rb") as f:
            for url, meta in plistlib.load(f).items():
                feed = meta.get("feedID", url) if isinstance(meta, dict) else url
                names.setdefault(feed, names.get(url) or urlparse(url).netloc or feed)
                for key in (meta.get("folderRelationship") or {}) if isinstance(meta, dict) else {}:
                    if "/label/" in key:
                        categories[feed] = key.split("/label/", 1)[1]
    except (OSError, ValueError, plistlib.InvalidFileException):
        pass
    return names, categories


def read_articles(spark: SparkSession, account: str) -> DataFrame:
    from lectern.functions.parsers import html_to_text_udf
    from lectern.operators import assemble

    db = os.path.join(account, "DB.sqlite3")
    names, categories = feed_metadata(account)
    feeds = spark.createDataFrame([(k, v, categories.get(k, "")) for k, v in names.items()], "feedID string, name string, category string")
    rows = read_table(spark, db, "articles")
    return assemble.articles(rows, read_table(spark, db, "authors"), read_table(spark, db, "authorsLookup"), feeds, html_to_text_udf)


def read_books(spark: SparkSession, library: str) -> DataFrame:
    """Books of a library with their linked lists, identifiers, description and formats."""
    from lectern.operators import assemble

    db = os.path.join(library, "metadata.db")
    t = lambda name: read_table(spark, db, name)
    from pyspark.sql import functions as F

    def linked(link: str, target: str, key: str, value: str) -> DataFrame:
        return t(link).select("book", F.col(key).alias("_k"), F.col("id").alias("pos")).join(t(target).select(F.col("id").alias("_k"), F.col(value).cast("string").alias("value")), "_k").select("book", "pos", "value")

    links = {
        "authors": linked("books_authors_link", "authors", "author", "name"),
        "tags": linked("books_tags_link", "tags", "tag", "name"),
        "languages": linked("books_languages_link", "languages", "lang_code", "lang_code"),
        "series": linked("books_series_link", "series", "series", "name"),
        "publisher": linked("books_publishers_link", "publishers", "publisher", "name"),
        "rating": linked("books_ratings_link", "ratings", "rating", "rating"),
    }
    ids = t("identifiers").select("book", F.col("type").alias("key"), F.col("val").alias("value"), F.col("id").alias("pos"))
    formats = t("data").select("book", F.col("format").alias("key"), F.col("name").alias("value"), F.col("id").alias("pos"))
    books = read_table(spark, db, "books", columns=["id", "title", "path", "pubdate", "last_modified", "series_index"])
    return assemble.books(books, links, ids, t("comments").select("book", "text"), formats)
