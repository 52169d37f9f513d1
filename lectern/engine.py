"""The engine as an object: search, list, inspect, index, prune over a store of Parquet tables.

Every change writes the tables it touches beside the old ones and then publishes a new
version, so a failed index run leaves the store as it was; a change that meets another
writer's is done again on the other's version. Sign bits are written with the vectors,
postings with the documents.
"""

from __future__ import annotations

import functools
import json
import os
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import chunking, dates, paths
from lectern.functions.code import code_blocks_udf
from lectern.functions.embedding import Embedder, HashEmbedder, HttpEmbedder, embed, resolve_host
from lectern.functions.parsers import PdfReader, documents_udf, parse_markdown_udf
from lectern.operators import catalog, fulltext, ingest
from lectern.operators.filters import SearchFilters
from lectern.operators.fusion import HybridSearch, score_text, source_uri
from lectern.session import materialize
from lectern.sources import files, git, sqlite
from lectern.storage import Conflict, TableStore

SCHEMAS = {
    "collections": "id long, collection_name string, collection_type string, description string, paths string, created_at string",
    "sources": "id long, collection_id long, source_type string, source_path string, file_hash string, file_modified_at string, last_indexed_at timestamp",
    "documents": "doc_id long, source_id long, collection_id long, chunk_index int, title string, content string, metadata string, created_at string",
    "vec_documents": "vec_rowid long, document_id long, embedding array<float>",
}
# Tables that follow from others and are written with them.
DERIVED = {
    "vec_documents_bin": "vec_rowid long, document_id long, embedding binary",
    "postings": "term string, doc_id long, dl int, at array<int>, bucket int",
    "corpus_stats": "n_docs long, n_tokens long, avg_len double",
}
CHUNK_BITS = 24  # of a document's id, for its number within the source


def _retried(change):
    """Do the change again when another writer has published in between."""

    @functools.wraps(change)
    def run(self, *args, **options):
        for attempt in range(self.attempts):
            try:
                return change(self, *args, **options)
            except Conflict:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)

    return run


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: Embedder | None = None, pdf: PdfReader | None = None, ocr: Callable | None = None, progress: Callable[[str, dict], None] | None = None, attempts: int = 5):
        """``embedder``: by default the model server of the configured hosts, without any a hashing stand-in;
        ``progress`` is told the name and the counts of every index step."""
        self.spark, self.config = spark, config or Config()
        c = self.config
        if embedder is None:
            embedder = HttpEmbedder(resolve_host(c.embedding_hosts, c.embedding_model), c.embedding_model, c.embedding_batch_size) if c.embedding_hosts else HashEmbedder(c.embedding_dimensions)
        self.embedder, self.pdf, self.ocr, self.progress, self.attempts = embedder, pdf, ocr, progress or (lambda name, counts: None), attempts
        self.files = TableStore(spark, self.config.store())
        self._base: tuple[int, dict[str, str], dict[str, DataFrame]] = (0, {}, {})

    # the store -----------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        _, folders = self.files.manifest()
        return self.files.read(folders.get(name), DERIVED.get(name) or SCHEMAS[name])

    def store(self) -> catalog.Store:
        version, folders = self.files.manifest()
        tables = {n: self.files.read(folders.get(n), schema) for n, schema in SCHEMAS.items()}
        self._base = (version, folders, tables)
        return catalog.Store(*tables.values())

    def commit(self, store: catalog.Store) -> None:
        """Write what differs from the version the change began from; a table that was not touched is the same object."""
        version, folders, tables = self._base
        folders = dict(folders)
        for (name, schema), df in zip(SCHEMAS.items(), (store.collections, store.sources, store.documents, store.vectors)):
            if df is not tables[name]:
                folders[name] = self.files.write(name, df.select(*[c.split()[0] for c in schema.split(", ")]))
        if folders.get("vec_documents") != self._base[1].get("vec_documents"):
            vectors = self.files.read(folders["vec_documents"], SCHEMAS["vec_documents"])
            folders["vec_documents_bin"] = self.files.write("vec_documents_bin", catalog.backfill_bits(vectors, self.config.embedding_dimensions))
        if folders.get("documents") != self._base[1].get("documents"):
            docs = self.files.read(folders["documents"], SCHEMAS["documents"])
            folders["postings"] = self.files.write("postings", fulltext.stored_postings(docs, "doc_id", "title", "content"), ("bucket",))
            folders["corpus_stats"] = self.files.write("corpus_stats", fulltext.corpus_stats(docs, "title", "content"))
        self.files.publish(version + 1, folders)

    @_retried
    def backfill(self) -> int:
        """Make the sign bits anew where they are missing or out of date; returns how many were."""
        self.store()
        wrong = catalog.vector_parity(self.table("vec_documents"), self.table("vec_documents_bin"), self.config.embedding_dimensions).count()
        if wrong:
            version, folders, _ = self._base
            bits = catalog.backfill_bits(self.table("vec_documents"), self.config.embedding_dimensions)
            self.files.publish(version + 1, folders | {"vec_documents_bin": self.files.write("vec_documents_bin", bits)})
        return wrong

    # queries -------------------------------------------------------------------
    def search(self, query: str, top_k: int | None = None, filters: SearchFilters | None = None, query_vector: list[float] | None = None) -> DataFrame:
        c = self.config
        hybrid = HybridSearch(self.table("documents"), self.table("vec_documents"), self.table("sources"), self.table("collections"), self.table("vec_documents_bin"), c.rrf_k, c.vector_weight, c.text_weight, (self.table("postings"), self.table("corpus_stats")))
        return hybrid.search(query, query_vector or self.embedder([query])[0], top_k or c.top_k, filters)

    def search_results(self, query: str, **options) -> list[dict]:
        rows = self.search(query, **options)
        rows = rows.withColumn("source_uri", source_uri(F.col("source_path"), F.col("source_type"), F.col("metadata"), {v: os.path.basename(v.rstrip("/")) for v in map(os.path.expanduser, self.config.vaults)}))
        rows = rows.withColumn("score_text", score_text(F.col("score"))).orderBy(F.desc("score"), "doc_id")
        return [{"content": r.content, "title": r.title, "metadata": json.loads(r.metadata) if r.metadata else {}, "score": r.score_text, "collection": r.collection_name, "source_path": r.source_path, "source_type": r.source_type, "source_uri": r.source_uri} for r in rows.collect()]

    def list_collections(self) -> list[dict]:
        return [r.asDict() for r in catalog.collection_stats(self.store()).orderBy("collection_name").collect()]

    def collection_info(self, name: str) -> dict:
        s = self.store()
        row = s.collections.where(F.col("collection_name") == name).first()
        if row is None:
            raise KeyError(name)
        stats = catalog.collection_stats(s).where(F.col("collection_name") == name).first().asDict()
        kinds = {r["source_type"]: r["n"] for r in catalog.source_type_breakdown(s, row["id"]).collect()}
        return stats | {"description": row["description"], "source_types": kinds, "sample_titles": [r["title"] for r in catalog.sample_titles(s, row["id"], 10).collect()]}

    # changes -------------------------------------------------------------------
    def get_or_create_collection(self, s: catalog.Store, name: str, kind: str, roots: list[str] | None) -> tuple[catalog.Store, int]:
        """The store with the collection and its id; of a known one only the paths change."""
        row = s.collections.where(F.col("collection_name") == name).first()
        shown = json.dumps(roots) if roots is not None else None
        if row is not None:
            moved = s.collections.withColumn("paths", F.when(F.col("id") == row["id"], F.lit(shown)).otherwise(F.col("paths"))) if shown else s.collections
            return replace(s, collections=moved), row["id"]
        new = (s.collections.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
        fresh = self.spark.range(1).select(F.lit(new).cast("long").alias("id"), F.lit(name).alias("collection_name"), F.lit(kind).alias("collection_type"), F.lit(None).cast("string").alias("description"), F.lit(shown).cast("string").alias("paths"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
        return replace(s, collections=s.collections.unionByName(fresh)), new

    @_retried
    def index_files(self, name: str, roots: list[str], kind: str = "project", force: bool = False) -> dict:
        """Index changed files below the roots. Everything is parsed, chunked and embedded before the
        store changes; files without text are skipped and tried again next time."""
        s, coll = self.get_or_create_collection(self.store(), name, kind, roots)
        scanned = files.scan_vaults(self.spark, roots, self.config.vault_exclude_folders) if name == "obsidian" else files.scan(self.spark, roots)
        # books belong to libraries
        found = scanned.where("source_type <> 'epub'").withColumn("collection_id", F.lit(coll).cast("long")).persist()
        try:
            total = found.count()
            changed = ingest.changed_files(found, s.sources, force)
            parts = changed.withColumn("part", F.explode(documents_udf(self.pdf, self.ocr)("source_type", "content"))).select("collection_id", "source_path", "source_type", "file_hash", "file_modified_at", "part.*")
            stem = F.regexp_replace(paths.base_name(F.col("source_path")), r"\.[^.]*$", "")
            note = parse_markdown_udf("text", stem)
            size, overlap = self.config.chunk_size, self.config.chunk_overlap
            md = parts.where("source_type = 'markdown'").withColumn("note", note)
            md_meta = F.when(F.col("note.frontmatter") == "{}", F.lit("")).otherwise(F.col("note.frontmatter"))
            md = md.select("collection_id", "source_path", "source_type", "file_hash", "file_modified_at", F.lit(0).alias("n"), md_meta.alias("file_meta"), F.explode(chunking.markdown_chunks(size, overlap)("note.body", "note.title")).alias("c"))
            md = md.select(*md.columns[:7], F.col("c.title").alias("title"), F.col("c.text").alias("content"), F.coalesce(F.nullif("c.metadata", F.lit("")), "file_meta").alias("metadata"), F.col("c.chunk_index").alias("k")).drop("file_meta")
            rest = parts.where("source_type <> 'markdown' and error is null").where(F.col("text").rlike(r"\S"))
            title = F.when(F.col("source_type") == "pdf", F.concat(stem, F.lit(" (page "), F.col("n").cast("string"), F.lit(")"))).when(F.col("n") > 0, F.concat(stem, F.lit(" (chapter "), F.col("n").cast("string"), F.lit(")"))).otherwise(stem)
            meta = F.when(F.col("source_type") == "pdf", F.to_json(F.struct(F.col("n").alias("page_number"), F.when(F.col("ocr"), True).alias("ocr")))).otherwise(F.lit(""))
            rest = rest.select("collection_id", "source_path", "source_type", "file_hash", "file_modified_at", "n", title.alias("title"), meta.alias("metadata"), F.posexplode(chunking.plain_chunks(F.col("text"), size, overlap)).alias("k", "content"))
            cols = ["collection_id", "source_path", "source_type", "file_hash", "file_modified_at", "n", "k", "title", "content", "metadata"]
            done, s = self._store_chunks(s, md.select(*cols).unionByName(rest.select(*cols)))
            self.commit(s)
            return {"indexed": done, "skipped": total - done, "errors": 0, "total_found": total}
        finally:
            found.unpersist()

    def _store_chunks(self, s: catalog.Store, rows: DataFrame) -> tuple[int, catalog.Store]:
        """Embed chunks (collection_id, source_path, source_type, file_hash, file_modified_at, n, k, title,
        content, metadata) and put them in place of what the store had of their sources. The embedded chunks
        are written first: nothing of the store changes if a model server fails."""
        chunks = materialize(embed(rows, self.embedder), "chunks")
        done = chunks.select("collection_id", "source_type", "source_path", "file_hash", "file_modified_at").dropDuplicates(["collection_id", "source_path"]).withColumn("last_indexed_at", F.current_timestamp())
        indexed = done.count()
        if not indexed:
            return 0, s
        sources = catalog.upsert_sources(s.sources, done)
        old = s.sources.join(done.select("collection_id", "source_path"), ["collection_id", "source_path"], "left_semi")
        kept = catalog.delete_sources(s, old.select("id"))
        new_ids = chunks.join(sources.select(F.col("id").alias("source_id"), "collection_id", "source_path"), ["collection_id", "source_path"])
        # a document's id is that of its source and its number there: no counting over all rows
        index = F.row_number().over(Window.partitionBy("source_id").orderBy("n", "k")) - 1
        numbered = materialize(new_ids.withColumn("chunk_index", index.cast("int")).withColumn("doc_id", F.shiftleft("source_id", CHUNK_BITS) + F.col("chunk_index")), "numbered")
        docs = numbered.select("doc_id", "source_id", "collection_id", "chunk_index", "title", "content", "metadata", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
        vecs = numbered.select(F.col("doc_id").alias("vec_rowid"), F.col("doc_id").alias("document_id"), "embedding")
        return indexed, catalog.Store(s.collections, sources, kept.documents.unionByName(docs), kept.vectors.unionByName(vecs.select(*kept.vectors.columns)))

    @_retried
    def _index_items(self, name: str, kind: str, source_type: str, items: DataFrame, force: bool, allow_late: bool = True) -> dict:
        """Items (source_path, title, body, metadata, date): those behind the watermark that the store does not
        have are chunked like mails. By default the natural key alone decides, so late rows are taken."""
        s, coll = self.get_or_create_collection(self.store(), name, kind, None)
        mine = items.withColumn("collection_id", F.lit(coll).cast("long"))
        total = mine.count()
        if not force:
            mark = catalog.watermark(s, coll).first()
            mine = ingest.since_watermark(mine, mark["watermark"] if mark else None, allow_late=allow_late)
            mine = ingest.not_indexed(mine, s.sources)
        run = chunking.email_chunks(self.config.chunk_size, self.config.chunk_overlap)
        rows = mine.withColumn("c", F.explode(run("title", "body"))).select(
            "collection_id", "source_path", F.lit(source_type).alias("source_type"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("string").alias("file_modified_at"),
            F.lit(0).alias("n"), F.col("c.chunk_index").alias("k"), F.col("c.title").alias("title"), F.col("c.text").alias("content"), "metadata",
        )
        done, s = self._store_chunks(s, rows)
        self.commit(s)
        return {"indexed": done, "skipped": total - done, "errors": 0, "total_found": total}

    def index_mail(self, accounts: list[str] | None = None, force: bool = False, allow_late: bool = True) -> dict:
        out = {"indexed": 0, "skipped": 0, "errors": 0, "total_found": 0}
        for account in accounts or sqlite.mail_accounts(os.path.expanduser(self.config.mail_path)):
            since = 0 if force or allow_late else self._since("email")
            mails = sqlite.read_mails(self.spark, account, since)
            meta = F.to_json(F.struct("sender", "recipients", "date", "folder"))
            items = mails.select(F.concat(F.lit("email://"), "message_id").alias("source_path"), F.col("subject").alias("title"), "body", meta.alias("metadata"), "date")
            out = {k: v + out[k] for k, v in self._index_items("email", "system", "email", items, force, allow_late).items()}
        return out

    def _since(self, name: str) -> int:
        """The watermark of a collection as ticks, for the source to filter by; 0 without one."""
        coll = self.table("collections").where(F.col("collection_name") == name).select("id").first()
        mark = catalog.watermark(self.store(), coll["id"]).first() if coll else None
        if not mark or not mark["watermark"]:
            return 0
        return self.spark.range(1).select(dates.iso_to_ticks(F.lit(mark["watermark"])).alias("t")).first()["t"] or 0

    def index_feeds(self, accounts: list[str] | None = None, force: bool = False, allow_late: bool = True) -> dict:
        out = {"indexed": 0, "skipped": 0, "errors": 0, "total_found": 0}
        for account in accounts or sqlite.feed_accounts(os.path.expanduser(self.config.feed_path)):
            rows = sqlite.read_articles(self.spark, account)
            meta = F.to_json(F.struct("url", "feed_name", "date", F.nullif("feed_category", F.lit("")).alias("feed_category"), F.when(F.size("authors") > 0, F.col("authors")).alias("authors")))
            items = rows.select(F.concat(F.lit("rss://"), F.col("id").cast("string")).alias("source_path"), "title", "body", meta.alias("metadata"), "date")
            out = {k: v + out[k] for k, v in self._index_items("rss", "system", "rss", items, force, allow_late).items()}
        return out

    def index_books(self, libraries: list[str] | None = None, force: bool = False) -> dict:
        """Books by their EPUB, else their PDF where it is on disk, then their description."""
        out = {"indexed": 0, "skipped": 0, "errors": 0, "total_found": 0}
        pdf, ocr, size, overlap = self.pdf, self.ocr, self.config.chunk_size, self.config.chunk_overlap
        for library in map(os.path.expanduser, libraries or self.config.book_libraries):
            s, coll = self.get_or_create_collection(self.store(), "calibre", "system", None)
            books = sqlite.read_books(self.spark, library)
            keep = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("authors", "tags", "languages")]
            meta = F.to_json(F.struct(*keep, "series", "publisher", "pubdate", "rating", "identifiers", F.col("id").alias("calibre_id"), F.lit(library).alias("library")))
            rows = books.select(F.concat(F.lit("calibre://"), F.lit(library), F.lit("/"), F.col("path")).alias("source_path"), "title", "path", "formats", "description", meta.alias("metadata"), F.lit(coll).cast("long").alias("collection_id"))
            total = rows.count()
            fresh = rows if force else ingest.not_indexed(rows, s.sources)

            def read(frames):
                import pandas as pd

                from lectern.functions.parsers import html_to_text, parse_epub, parse_pdf

                for frame in frames:
                    got = []
                    for r in frame.itertuples(index=False):
                        files_ = dict(r.formats) if r.formats is not None else {}
                        parts = []
                        for ext in ("EPUB", "PDF"):
                            file = os.path.join(library, r.path, f"{files_.get(ext)}.{ext.lower()}")
                            if ext not in files_ or not os.path.exists(file):
                                continue
                            with open(file, "rb") as f:
                                data = f.read()
                            base = json.loads(r.metadata)
                            if ext == "EPUB":
                                parts = [(f"chapter {n}", t, base | {"format": ext, "chapter_number": n}) for n, t in parse_epub(data)]
                            elif pdf is not None:
                                parts = [(f"page {n}", t, base | {"format": ext, "page_number": n} | ({"ocr": True} if o else {})) for n, t, o in parse_pdf(data, pdf, ocr)]
                            break
                        if r.description:
                            parts.append(("description", html_to_text(r.description), json.loads(r.metadata) | {"chunk_type": "description"}))
                        for c in chunking.part_chunks(parts, r.title or "", size, overlap):
                            got.append((r.collection_id, r.source_path, "calibre", None, None, 0, c["chunk_index"], c["title"], c["text"], c["metadata"]))
                    yield pd.DataFrame(got, columns=["collection_id", "source_path", "source_type", "file_hash", "file_modified_at", "n", "k", "title", "content", "metadata"])

            chunks = fresh.mapInPandas(read, "collection_id long, source_path string, source_type string, file_hash string, file_modified_at string, n int, k int, title string, content string, metadata string")
            done, s = self._store_chunks(s, chunks)
            self.commit(s)
            got = {"indexed": done, "skipped": total - done, "errors": 0, "total_found": total}
            out = {k: v + out[k] for k, v in got.items()}
        return out

    def index_code(self, name: str, roots: list[str], history: bool = False, force: bool = False) -> dict:
        """Tracked files of the repositories below the roots, and their commits if asked; the head of each
        repository is kept in the collection's description, so an unchanged one costs one git call."""
        out = {"indexed": 0, "skipped": 0, "errors": 0, "total_found": 0}
        size, overlap = self.config.chunk_size, self.config.chunk_overlap
        for repo in git.resolve(roots):
            s, coll = self.get_or_create_collection(self.store(), name, "code", roots)
            row = s.collections.where(F.col("id") == coll).first()
            marks = ingest.parse_watermarks(row["description"])
            head = git.head(repo)
            if marks.get(repo) == head and not force:
                continue
            changed = None if force else git.changed_since(repo, marks.get(repo))
            tracked = git.tracked(self.spark, repo).persist()
            todo = tracked if changed is None else self.spark.createDataFrame([(c,) for c in changed], "path string").join(tracked, "path", "left_semi")
            texts = git.read_files(todo, repo).withColumn("collection_id", F.lit(coll).cast("long")).withColumn("source_path", F.concat(F.lit(repo + "/"), "path"))
            total = texts.count()
            texts = ingest.changed_files(texts, s.sources, force)
            block = texts.select("*", F.posexplode(code_blocks_udf(size, overlap)("text", "language")).alias("k", "b")).drop("text")
            head_line = chunking.code_header(F.col("path"), F.col("b.start_line"), F.col("b.end_line"), F.col("language"), F.col("b.symbol_type"), F.col("b.symbol_path"), F.col("b.symbol"))
            meta = F.to_json(F.struct("language", F.col("b.symbol").alias("symbol_name"), F.col("b.symbol_type").alias("symbol_type"), F.col("b.start_line").alias("start_line"), F.col("b.end_line").alias("end_line"), F.col("path").alias("file_path"), F.nullif("b.symbol_path", F.lit("")).alias("symbol_path")))
            cols = ["collection_id", "source_path", "source_type", "file_hash", "file_modified_at", "n", "k", "title", "content", "metadata"]
            rows = block.select("collection_id", "source_path", F.lit("code").alias("source_type"), "file_hash", F.lit(None).cast("string").alias("file_modified_at"), F.lit(0).alias("n"), "k", F.col("path").alias("title"), F.concat(head_line, F.lit("\n"), F.col("b.text")).alias("content"), meta.alias("metadata")).select(*cols)
            if history:
                log = git.not_blacklisted(git.commits(self.spark, repo, marks.get(f"{repo}:history"), self.config.git_history_months), self.config.git_subject_blacklist)
                paths_ = log.withColumn("source_path", F.concat(F.lit(f"git://{repo}#"), "sha")).withColumn("collection_id", F.lit(coll).cast("long"))
                fresh = ingest.not_indexed(paths_, s.sources)
                files_ = git.file_changes(fresh, repo)
                top = chunking.commit_header(F.lit(os.path.basename(repo)), F.col("path"), F.col("sha"), F.col("author_date"))
                m = F.to_json(F.struct(F.col("sha").alias("commit_sha"), F.substring("sha", 1, 7).alias("commit_sha_short"), "author_name", "author_email", "author_date", F.col("subject").alias("commit_message"), F.col("path").alias("file_path"), "additions", "deletions"))
                shown = files_.select("*", m.alias("metadata"), F.posexplode(chunking.commit_chunks(top, F.col("subject"), F.col("diff"), size, overlap)).alias("k", "content"))
                order = F.row_number().over(Window.partitionBy("sha").orderBy("path", "k")).cast("int")
                rows = rows.unionByName(shown.select("collection_id", "source_path", F.lit("commit").alias("source_type"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("string").alias("file_modified_at"), F.lit(0).alias("n"), order.alias("k"), F.col("subject").alias("title"), "content", "metadata").select(*cols))
            done, s = self._store_chunks(s, rows)
            gone = [] if changed is None else [f"{repo}/{c}" for c in changed]
            if gone:
                dead = s.sources.where((F.col("collection_id") == coll) & F.col("source_path").isin(gone)).join(tracked.select(F.concat(F.lit(repo + "/"), "path").alias("source_path")), "source_path", "left_anti")
                s = catalog.delete_sources(s, dead.select("id"))
            marks |= {repo: head} | ({f"{repo}:history": head} if history else {})
            s = replace(s, collections=s.collections.withColumn("description", F.when(F.col("id") == coll, F.lit(json.dumps(marks))).otherwise(F.col("description"))))
            self.commit(s)
            tracked.unpersist()
            got = {"indexed": done, "skipped": max(0, total - done), "errors": 0, "total_found": total}
            out = {k: v + out[k] for k, v in got.items()}
        return out

    @_retried
    def prune_files(self, name: str) -> dict:
        """Drop the collection's sources whose files are gone; commits and other URIs stay."""
        s = self.store()
        coll = s.collections.where(F.col("collection_name") == name).first()
        if coll is None:
            return {"checked": 0, "pruned": 0}
        mine = s.sources.where((F.col("collection_id") == coll["id"]) & ~F.col("source_path").contains("://"))
        there = files.scan(self.spark, json.loads(coll["paths"] or "[]")).select("source_path")
        stale = ingest.stale_sources(mine, there).persist()
        result = ingest.prune_result(mine, stale).first().asDict()
        if result["pruned"]:
            self.commit(catalog.delete_sources(s, stale.select("id")))
        return result

    @_retried
    def _prune_to(self, name: str, current: DataFrame | None) -> dict:
        """Drop the collection's sources that are not among the current ones; an unreadable or empty source
        prunes nothing, as a failure must never pass for an empty list."""
        s = self.store()
        coll = s.collections.where(F.col("collection_name") == name).first()
        if coll is None or current is None or current.isEmpty():
            return {"checked": 0, "pruned": 0}
        mine = s.sources.where(F.col("collection_id") == coll["id"])
        stale = materialize(ingest.stale_sources(mine, current), "stale")
        result = ingest.prune_result(mine, stale).first().asDict()
        if result["pruned"]:
            self.commit(catalog.delete_sources(s, stale.select("id")))
        return result

    def prune(self, name: str) -> dict:
        """By the name of the collection (mail, feeds, books), else by its files."""
        readers = {
            "email": lambda: [sqlite.read_mails(self.spark, a).select(F.concat(F.lit("email://"), "message_id").alias("source_path")) for a in sqlite.mail_accounts(os.path.expanduser(self.config.mail_path))],
            "rss": lambda: [sqlite.read_table(self.spark, os.path.join(a, "DB.sqlite3"), "articles", columns=["articleID"]).select(F.concat(F.lit("rss://"), F.col("articleID").cast("string")).alias("source_path")) for a in sqlite.feed_accounts(os.path.expanduser(self.config.feed_path))],
            "calibre": lambda: [sqlite.read_table(self.spark, os.path.join(os.path.expanduser(b), "metadata.db"), "books", columns=["path"]).select(F.concat(F.lit(f"calibre://{os.path.expanduser(b)}/"), "path").alias("source_path")) for b in self.config.book_libraries],
        }
        if name not in readers:
            return self.prune_files(name)
        try:
            parts = readers[name]()
        except Exception as e:  # an unreadable source prunes nothing, and says why
            return {"checked": 0, "pruned": 0, "message": str(e)[:300]}
        current = None
        for p in parts:
            current = p if current is None else current.unionByName(p)
        return self._prune_to(name, current)

    def prune_all(self) -> dict:
        out = {"checked": 0, "pruned": 0}
        for row in self.store().collections.select("collection_name").collect():
            if self.config.enabled(row["collection_name"]):
                got = self.prune(row["collection_name"])
                out |= {k: got[k] + out[k] for k in ("checked", "pruned")}
        return out

    def collection_paths(self, name: str) -> list[str] | None:
        row = self.store().collections.where(F.col("collection_name") == name).first()
        if row is None:
            raise KeyError(name)
        return json.loads(row["paths"]) if row["paths"] else None

    @_retried
    def set_collection_paths(self, name: str, roots: list[str] | None) -> None:
        self.collection_paths(name)
        s = self.store()
        shown = F.lit(json.dumps(roots) if roots is not None else None).cast("string")
        self.commit(replace(s, collections=s.collections.withColumn("paths", F.when(F.col("collection_name") == name, shown).otherwise(F.col("paths")))))

    @_retried
    def rewrite_paths(self, name: str, old: str, new: str) -> int:
        s = self.store()
        coll = s.collections.where(F.col("collection_name") == name).first()
        if coll is None:
            raise KeyError(name)
        mine = F.col("collection_id") == coll["id"]
        n = s.sources.where(mine & F.col("source_path").startswith(old)).count()
        if n:
            self.commit(replace(s, sources=catalog.rewrite_paths(s.sources, old, new, mine)))
        return n

    def export(self, name: str) -> DataFrame:
        """(id, source): one JSON object per source, to be written where it is wanted."""
        return catalog.export_collection(self.store(), name)

    def index_all(self, force: bool = False, prune: bool = True, history: bool = False) -> dict[str, dict]:
        """Every configured source after a prune of its files; one that fails is reported, the rest goes on."""
        c, jobs = self.config, {}
        if c.vaults:
            jobs["obsidian"] = lambda: self.index_files("obsidian", c.vaults, "system", force)
        if c.mail_path:
            jobs["email"] = lambda: self.index_mail(force=force)
        if c.feed_path:
            jobs["rss"] = lambda: self.index_feeds(force=force)
        if c.book_libraries:
            jobs["calibre"] = lambda: self.index_books(force=force)
        jobs |= {n: lambda n=n: self.index_code(n, c.repositories[n], history, force=force) for n in sorted(c.repositories)}
        jobs |= {n: lambda n=n: self.index_files(n, c.projects[n], "project", force) for n in sorted(c.projects)}
        out = {}
        for name, job in jobs.items():
            if not c.enabled(name):
                continue
            try:
                if prune and name in ("obsidian", *c.repositories, *c.projects):
                    self.prune(name)
                out[name] = job()
            except Exception as e:
                out[name] = {"indexed": 0, "skipped": 0, "errors": 1, "total_found": 0, "message": str(e)[:300]}
            self.progress(name, out[name])
        return out

    def reindex_every(self, stop: Callable[[], bool], sleep: Callable[[float], None] = time.sleep) -> int:
        """``index_all`` at the configured interval until ``stop`` says so; at once if none is configured.
        Returns the number of runs."""
        runs = 0
        while True:
            self.index_all()
            runs += 1
            if stop() or not self.config.reindex_interval_minutes:
                return runs
            sleep(60.0 * self.config.reindex_interval_minutes)

    @_retried
    def delete_collection(self, name: str) -> None:
        self.commit(catalog.delete_collection(self.store(), name))
