"""Reciprocal rank fusion, hydration and presentation of hybrid search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import fulltext, vector
from lectern.operators.filters import SearchFilters


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Positions from 1; the rows are a branch's bounded pool."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def rrf_merge(vec: DataFrame, fts: DataFrame, id_col: str, k: int = 60, vector_weight: float = 0.7, text_weight: float = 0.3) -> DataFrame:
    """(id, score): sum of weight / (k + position) over the branches that have the id."""
    parts = vec.select(id_col, (F.lit(float(vector_weight)) / (k + F.col("pos"))).alias("score"))
    parts = parts.unionByName(fts.select(id_col, (F.lit(float(text_weight)) / (k + F.col("pos"))).alias("score")))
    return parts.groupBy(id_col).agg(F.sum("score").alias("score"))


def hydrate(hits: DataFrame, documents: DataFrame, sources: DataFrame, collections: DataFrame) -> DataFrame:
    """Candidates with their document, source and collection; what has none is dropped. The small side is
    the hits, so Spark broadcasts them by their size."""
    c = collections.select(F.col("id").alias("collection_id"), "collection_name", "collection_type")
    s = sources.select(F.col("id").alias("source_id"), "source_type", "source_path")
    return hits.join(documents, "doc_id").join(s, "source_id").join(c, "collection_id")


class HybridSearch:
    """Both branches, filters after each pool and before ranks are given, fusion, cut, hydration."""

    def __init__(self, documents: DataFrame, vectors: DataFrame, sources: DataFrame, collections: DataFrame, bits: DataFrame, rrf_k: int = 60, vector_weight: float = 0.7, text_weight: float = 0.3, index: tuple[DataFrame, DataFrame] | None = None):
        """``index``: stored postings and corpus statistics; without them the texts are searched."""
        self.documents, self.sources, self.collections, self.bits, self.index = documents, sources, collections, bits, index
        self.vectors = vectors.select("vec_rowid", F.col("document_id").alias("doc_id"), "embedding")
        self.rrf = (rrf_k, vector_weight, text_weight)

    def _passing(self, rows: DataFrame, filters: SearchFilters) -> DataFrame:
        if not filters.any():
            return rows
        slim = self.documents.select("doc_id", "source_id", "collection_id", "metadata")
        return hydrate(rows, slim, self.sources, self.collections).where(filters.predicate()).select(*rows.columns)

    def vector_branch(self, query: list[float], top_k: int, filters: SearchFilters) -> DataFrame:
        pool = vector.two_phase(self.bits.select("vec_rowid", "embedding"), self.vectors, query, top_k, "vec_rowid", filters.any()).select("vec_rowid", "doc_id", "distance")
        return ranked(self._passing(pool, filters), "distance", "doc_id", "vec_rowid").where(F.col("pos") <= top_k)

    def text_branch(self, text: str, top_k: int, filters: SearchFilters) -> DataFrame:
        hits = fulltext.bm25_stored(*self.index, text, "doc_id") if self.index else fulltext.bm25(self.documents, text, "doc_id", "title", "content")
        found = hits.orderBy("rank", "doc_id").limit(fulltext.candidate_limit(top_k, filters.any()))
        return ranked(self._passing(found, filters), "rank", "doc_id").where(F.col("pos") <= top_k)

    def merged(self, text: str, query: list[float], top_k: int = 10, filters: SearchFilters | None = None) -> DataFrame:
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        filters = filters or SearchFilters()
        both = rrf_merge(self.vector_branch(query, top_k, filters), self.text_branch(text, top_k, filters), "doc_id", *self.rrf)
        return both.orderBy(F.desc("score"), "doc_id").limit(top_k)

    def search(self, text: str, query: list[float], top_k: int = 10, filters: SearchFilters | None = None) -> DataFrame:
        hits = hydrate(self.merged(text, query, top_k, filters), self.documents, self.sources, self.collections)
        return hits.select("doc_id", "score", "title", "content", "metadata", "collection_name", "source_path", "source_type")


def score_text(score: Column) -> Column:
    return F.format_string("%.4f", score)


def snippet(content: Column, size: int = 300) -> Column:
    flat = F.replace(content, F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def query_escape(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_uri(path: Column, source_type: Column, metadata: Column, vaults: dict[str, str] | None = None) -> Column:
    """A link to the source, or null for what has none. ``vaults``: name by folder."""
    url = F.get_json_object(metadata, "$.url")
    url = F.when(url != "", url)
    line = F.coalesce(F.get_json_object(metadata, "$.start_line"), F.lit("1"))
    out = F.when(source_type == "rss", url).when((source_type == "markdown") & url.isNotNull(), url)
    out = out.when(source_type.isin("email", "commit") | path.startswith("calibre://") | path.startswith("git://"), F.lit(None).cast("string"))
    for folder, name in (vaults or {}).items():
        inside = F.substr(path, F.lit(len(folder.rstrip("/")) + 2))
        out = out.when(path.startswith(folder.rstrip("/") + "/"), F.concat(F.lit("obsidian://open?vault="), query_escape(F.lit(name)), F.lit("&file="), query_escape(inside)))
    out = out.when(source_type == "code", F.concat(F.lit("vscode://file"), path, F.lit(":"), line))
    return out.otherwise(F.concat(F.lit("file://"), path))
