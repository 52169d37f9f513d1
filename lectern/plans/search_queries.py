"""Vector, full-text, hybrid and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import fulltext, vector
from lectern.operators.filters import SearchFilters
from lectern.operators.fusion import HybridSearch, hydrate, ranked, rrf_merge, score_text, snippet, source_uri
from lectern.plans.core_queries import register
from lectern.session import new_shared_path, table

QUERY_ROW, TOP = 11, 10
QV = f"(SELECT embedding FROM vec_documents WHERE vec_rowid = {QUERY_ROW})"
_L2 = "CASE WHEN len(embedding) = 64 THEN list_sum(list_transform(list_zip(embedding, e), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) ELSE 'infinity'::DOUBLE END"
_BITS = "array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN e[i - i % 8 + 7 - i % 8 + 1] > 0 AND NOT isnan(e[i - i % 8 + 7 - i % 8 + 1]) THEN '1' ELSE '0' END), '')::BIT"
_HAMMING = f"SELECT vec_rowid, e, bit_count(xor(embedding::BIT, q)) AS h FROM vec_documents_bin, (SELECT e, {_BITS} AS q FROM (SELECT {QV} AS e)) WHERE octet_length(embedding) = 8 ORDER BY h, vec_rowid LIMIT {{pool}}"
_POOL = f"SELECT v.vec_rowid, v.document_id, v.embedding, b.e, b.h FROM ({_HAMMING}) b JOIN vec_documents v ON v.vec_rowid = b.vec_rowid"


def query_vector(spark, sf) -> list[float]:
    return table(spark, sf, "vec_documents").where(F.col("vec_rowid") == QUERY_ROW).select("embedding").first()[0]


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark, sf):
    """(postings, statistics) of the documents of a folder, written at the first search of a session, as
    indexing would have done."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        docs, path = table(spark, sf, "documents"), new_shared_path(spark, "postings")
        fulltext.stored_postings(docs, "doc_id", "title", "content").write.partitionBy("bucket").parquet(f"{path}/postings")
        fulltext.corpus_stats(docs, "title", "content").write.parquet(f"{path}/stats")
        _STORED[key] = path
    return spark.read.parquet(f"{_STORED[key]}/postings"), spark.read.parquet(f"{_STORED[key]}/stats")


def engine(spark, sf) -> HybridSearch:
    return HybridSearch(*[table(spark, sf, t) for t in ("documents", "vec_documents", "sources", "collections", "vec_documents_bin")], index=stored_index(spark, sf))


@register(
    "vec_quantize_bits",
    """SELECT vec_rowid, array_to_string(list_transform(range(0, 8), lambda k: printf('%02X', CAST(list_sum(list_transform(range(0, 8), lambda i:
         CASE WHEN embedding[k * 8 + i + 1] > 0 AND NOT isnan(embedding[k * 8 + i + 1]) THEN 1 << i::INT ELSE 0 END)) AS INT))), '') AS bits
       FROM vec_documents WHERE len(embedding) = 64""",
)
def vec_quantize_bits(spark, sf):
    bits = table(spark, sf, "vec_documents").select("vec_rowid", F.hex(vector.sign_bits("embedding", 64)).alias("bits"))
    return bits.where("bits is not null")


@register("vec_hamming_topk", f"SELECT vec_rowid, h::BIGINT AS hamming FROM ({_HAMMING.format(pool=200)})")
def vec_hamming_topk(spark, sf):
    rows = vector.bits_topk(table(spark, sf, "vec_documents_bin"), query_vector(spark, sf), 200, "vec_rowid")
    return rows.select("vec_rowid", F.col("hamming").cast("long").alias("hamming"))


@register("vec_l2_exact_topk", f"SELECT vec_rowid, round({_L2}, 6) AS distance FROM vec_documents, (SELECT {QV} AS e) q WHERE len(embedding) = 64 ORDER BY {_L2}, vec_rowid LIMIT {TOP}")
def vec_l2_exact_topk(spark, sf):
    rows = vector.exact_topk(table(spark, sf, "vec_documents"), query_vector(spark, sf), TOP, "vec_rowid")
    return rows.select("vec_rowid", F.round("distance", 6).alias("distance"))


@register("vec_two_phase_topk", f"SELECT vec_rowid, round({_L2}, 6) AS distance FROM ({_POOL.format(pool=200)}) ORDER BY {_L2}, vec_rowid LIMIT {TOP}")
def vec_two_phase_topk(spark, sf):
    rows = vector.two_phase(table(spark, sf, "vec_documents_bin").select("vec_rowid", "embedding"), table(spark, sf, "vec_documents"), query_vector(spark, sf), TOP, "vec_rowid")
    return rows.orderBy("distance", "vec_rowid").limit(TOP).select("vec_rowid", F.round("distance", 6).alias("distance"))


_FILTERED = """JOIN documents d ON d.doc_id = p.document_id JOIN sources s ON s.id = d.source_id JOIN collections c ON c.id = d.collection_id WHERE c.collection_type = 'system' AND s.source_type = 'email'"""


@register("vec_filtered_topk", f"SELECT vec_rowid, document_id AS doc_id, round({_L2}, 6) AS distance FROM ({_POOL.format(pool=1000)}) p {_FILTERED} ORDER BY {_L2}, document_id, vec_rowid LIMIT {TOP}")
def vec_filtered_topk(spark, sf):
    rows = engine(spark, sf).vector_branch(query_vector(spark, sf), TOP, SearchFilters(collection="system", source_type="email"))
    return rows.select("vec_rowid", "doc_id", F.round("distance", 6).alias("distance"))


@register("vec_prefilter_topk", f"SELECT vec_rowid, document_id AS doc_id, round({_L2}, 6) AS distance FROM (SELECT v.*, q.e FROM vec_documents v, (SELECT {QV} AS e) q WHERE len(v.embedding) = 64) p {_FILTERED} ORDER BY {_L2}, vec_rowid LIMIT {TOP}")
def vec_prefilter_topk(spark, sf):
    """An extension: filters below the cut, so the answer is full if enough rows pass."""
    docs = table(spark, sf, "documents").select("doc_id", "source_id", "collection_id", "metadata")
    v = table(spark, sf, "vec_documents").where(F.size("embedding") == 64).withColumnRenamed("document_id", "doc_id")
    passing = hydrate(v, docs, table(spark, sf, "sources"), table(spark, sf, "collections")).where(SearchFilters(collection="system", source_type="email").predicate())
    return vector.exact_topk(passing, query_vector(spark, sf), TOP, "vec_rowid").select("vec_rowid", "doc_id", F.round("distance", 6).alias("distance"))


_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_BOTH = f"list_concat({_TOK.format('title')}, {_TOK.format('content')})"


@register("fts_postings", f"SELECT term, doc_id, count(*) AS tf, dl::BIGINT AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {_BOTH} AS t FROM documents)) GROUP BY term, doc_id, dl")
def fts_postings(spark, sf):
    rows, _ = stored_index(spark, sf)
    return rows.select("term", "doc_id", F.size("at").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@register("fts_doc_frequency", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_BOTH}) AS term FROM documents) GROUP BY term")
def fts_doc_frequency(spark, sf):
    return stored_index(spark, sf)[0].groupBy("term").agg(F.count("*").alias("df"))


@register("fts_corpus_stats", f"SELECT count(*) AS n_docs, sum(len({_BOTH}))::BIGINT AS n_tokens, round(avg(len({_BOTH})), 6) AS avg_len FROM documents")
def fts_corpus_stats(spark, sf):
    return stored_index(spark, sf)[1].withColumn("avg_len", F.round("avg_len", 6))


def _bm25_sql(phrases: list[str], limit: int | None = None) -> str:
    """Single-token phrases only."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{p}')) AS tf{j}" for j, p in enumerate(phrases))
    df = ", ".join(f"sum(CASE WHEN tf{j} > 0 THEN 1 ELSE 0 END) AS df{j}" for j in range(len(phrases)))
    idf = lambda j: f"greatest(ln((n - df{j} + 0.5e0) / (df{j} + 0.5e0)), 1e-6)"
    score = " + ".join(f"(CASE WHEN ln((n - df{j} + 0.5e0) / (df{j} + 0.5e0)) > 0 THEN {idf(j)} ELSE 1e-6 END) * tf{j} * 2.2e0 / (tf{j} + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))" for j in range(len(phrases)))
    hit = " AND ".join(f"tf{j} > 0" for j in range(len(phrases)))
    return f"""SELECT doc_id, round(-({score}), 9) AS rank FROM (SELECT doc_id, len(t) AS dl, {tf} FROM (SELECT doc_id, {_BOTH} AS t FROM documents)) r,
      (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM (SELECT len(t) AS dl, {tf} FROM (SELECT {_BOTH} AS t FROM documents))) s WHERE {hit}""" + (f" ORDER BY -({score}), doc_id LIMIT {limit}" if limit else "")


@register("fts_match_and", _bm25_sql(["telescope", "parcel"]).replace("SELECT doc_id, round(", "SELECT doc_id FROM (SELECT doc_id, round(", 1) + ")")
def fts_match_and(spark, sf):
    return fulltext.bm25_stored(*stored_index(spark, sf), "telescope parcel", "doc_id").select("doc_id")


@register("fts_bm25_topk", _bm25_sql(["telescope", "ledger"], 30))
def fts_bm25_topk(spark, sf):
    rows = fulltext.bm25_stored(*stored_index(spark, sf), "telescope ledger", "doc_id")
    return rows.orderBy("rank", "doc_id").limit(30).select("doc_id", F.round("rank", 9).alias("rank"))


@register(
    "fts_phrase_match",
    f"""SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOK.format("title")}, ' ') || ' ', ' well known ')
        OR contains(' ' || array_to_string({_TOK.format("content")}, ' ') || ' ', ' well known ')""",
)
def fts_phrase_match(spark, sf):
    return fulltext.bm25_stored(*stored_index(spark, sf), "well-known", "doc_id").select("doc_id")


_SYS = "JOIN documents d ON d.doc_id = f.doc_id JOIN sources s ON s.id = d.source_id JOIN collections c ON c.id = d.collection_id WHERE c.collection_type = 'system'"


@register("fts_filtered_topk", f"SELECT f.doc_id, f.rank FROM (SELECT doc_id, rank, row_number() OVER (ORDER BY raw, doc_id) AS pos FROM (SELECT *, rank AS raw FROM ({_bm25_sql(['telescope'], 500)}))) f {_SYS} ORDER BY f.pos LIMIT 10")
def fts_filtered_topk(spark, sf):
    rows = engine(spark, sf).text_branch("telescope", TOP, SearchFilters(collection="system"))
    return rows.select("doc_id", F.round("rank", 9).alias("rank"))


_HYBRID = f"""WITH v AS (SELECT document_id AS doc_id, row_number() OVER (ORDER BY {_L2}, document_id, vec_rowid) AS pos FROM ({_POOL.format(pool=200)})),
 t AS (SELECT doc_id, row_number() OVER (ORDER BY rank, doc_id) AS pos FROM ({_bm25_sql(["telescope", "ledger"], 30)})),
 u AS (SELECT doc_id, 0.7e0 / (60 + pos) AS s FROM v WHERE pos <= 10 UNION ALL SELECT doc_id, 0.3e0 / (60 + pos) FROM t WHERE pos <= 10),
 m AS (SELECT doc_id, sum(s) AS score FROM u GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 10)
SELECT m.doc_id, round(m.score, 9) AS score, d.title, c.collection_name, s.source_path, s.source_type
FROM m JOIN documents d ON d.doc_id = m.doc_id JOIN sources s ON s.id = d.source_id JOIN collections c ON c.id = d.collection_id"""


@register("hybrid_search", _HYBRID)
def hybrid_search(spark, sf):
    hits = engine(spark, sf).search("telescope ledger", query_vector(spark, sf), TOP)
    return hits.select("doc_id", F.round("score", 9).alias("score"), "title", "collection_name", "source_path", "source_type")


_LISTS = "AND contains(lower(json_extract_string(CASE WHEN d.metadata = '' THEN NULL ELSE d.metadata END, '$.folder')), 'list')"
_SYSTEM = _SYS + " AND s.source_type = 'email' " + _LISTS
_HYBRID_FILTERED = f"""WITH v AS (SELECT p.document_id AS doc_id, row_number() OVER (ORDER BY {_L2}, document_id, vec_rowid) AS pos FROM ({_POOL.format(pool=1000)}) p {_FILTERED} {_LISTS}),
 t AS (SELECT f.doc_id, row_number() OVER (ORDER BY f.rank, f.doc_id) AS pos FROM ({_bm25_sql(["telescope"], 500)}) f {_SYSTEM}),
 u AS (SELECT doc_id, 0.7e0 / (60 + pos) AS s FROM v WHERE pos <= 10 UNION ALL SELECT doc_id, 0.3e0 / (60 + pos) FROM t WHERE pos <= 10),
 m AS (SELECT doc_id, sum(s) AS score FROM u GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 10)
SELECT m.doc_id, round(m.score, 9) AS score, printf('%.4f', m.score) AS score_text, d.title, s.source_path FROM m JOIN documents d ON d.doc_id = m.doc_id JOIN sources s ON s.id = d.source_id"""


@register("hybrid_search_filtered", _HYBRID_FILTERED)
def hybrid_search_filtered(spark, sf):
    f = SearchFilters(collection="system", source_type="email", metadata={"folder": "list"})
    hits = engine(spark, sf).search("telescope", query_vector(spark, sf), TOP, f)
    return hits.select("doc_id", F.round("score", 9).alias("score"), score_text(F.col("score")).alias("score_text"), "title", "source_path")


@register(
    "rrf_merge",
    """WITH v(doc_id, pos) AS (VALUES (1::BIGINT, 1), (2, 2), (3, 3)), t(doc_id, pos) AS (VALUES (2::BIGINT, 1), (4, 2), (1, 3))
       SELECT doc_id, round(sum(s), 9) AS score FROM (SELECT doc_id, 0.7e0 / (60 + pos) AS s FROM v UNION ALL SELECT doc_id, 0.3e0 / (60 + pos) FROM t) GROUP BY doc_id""",
)
def rrf_merge_query(spark, sf):
    v = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc_id long, pos int")
    t = spark.createDataFrame([(2, 1), (4, 2), (1, 3)], "doc_id long, pos int")
    return rrf_merge(v, t, "doc_id").withColumn("score", F.round("score", 9))


@register("rrf_rank_events", "SELECT user_id, round(sum(0.7e0 / (60 + pos)), 9) AS score FROM (SELECT user_id, row_number() OVER (ORDER BY v DESC, user_id) AS pos FROM (SELECT user_id, max(value) AS v FROM events GROUP BY user_id)) WHERE pos <= 100 GROUP BY user_id")
def rrf_rank_events(spark, sf):
    best = table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("v")).orderBy(F.desc("v"), "user_id").limit(100)
    none = spark.createDataFrame([], "user_id long, pos int")
    return rrf_merge(ranked(best, F.desc("v"), "user_id"), none, "user_id").withColumn("score", F.round("score", 9))


@register(
    "hybrid_hydrate",
    """SELECT d.doc_id, c.collection_name, c.collection_type, s.source_type, s.source_path FROM documents d JOIN sources s ON s.id = d.source_id JOIN collections c ON c.id = d.collection_id""",
)
def hybrid_hydrate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source_id", "collection_id")
    rows = hydrate(docs.select("doc_id"), docs, table(spark, sf, "sources"), table(spark, sf, "collections"))
    return rows.select("doc_id", "collection_name", "collection_type", "source_type", "source_path")


_HYD = "FROM documents d JOIN sources s ON s.id = d.source_id JOIN collections c ON c.id = d.collection_id WHERE "
_META = "CASE WHEN d.metadata = '' THEN NULL ELSE d.metadata END"
_FILTER_CASES = {
    "filter_collection_type": (SearchFilters(collection="code"), "c.collection_type = 'code'"),
    "filter_collection_name": (SearchFilters(collection="garden-club"), "c.collection_name = 'garden-club'"),
    "filter_source_type": (SearchFilters(source_type="markdown"), "s.source_type = 'markdown'"),
    "filter_path_substring": (SearchFilters(path="VAULT-Tra"), "contains(lower(s.source_path), 'vault-tra')"),
    "filter_sender": (SearchFilters(sender="Ninefold"), f"contains(lower(coalesce(json_extract_string({_META}, '$.sender'), '')), 'ninefold')"),
    "filter_meta_string": (SearchFilters(metadata={"folder": "INB"}), f"contains(lower(json_extract_string({_META}, '$.folder')), 'inb')"),
    "filter_meta_list": (SearchFilters(metadata={"tags": "ar"}), f"json_type({_META}, '$.tags') = 'ARRAY' AND contains(lower(json_extract_string({_META}, '$.tags')), 'ar')"),
    "filter_meta_number": (SearchFilters(metadata={"chapter_number": 5}), f"json_extract_string({_META}, '$.chapter_number') = '5'"),
    "filter_combined": (SearchFilters(collection="system", sender="brackwater", metadata={"folder": "list"}), f"c.collection_type = 'system' AND contains(lower(coalesce(json_extract_string({_META}, '$.sender'), '')), 'brackwater') AND contains(lower(json_extract_string({_META}, '$.folder')), 'list')"),
}


_LITERAL = {
    "filter_author_list": (SearchFilters(author="KUO"), ("1", "4")),
    "filter_date_from": (SearchFilters(date_from="2024-06-01"), ("2", "3", "4", "5")),
    "filter_date_to": (SearchFilters(date_to="2024-06-01"), ("1", "2", "3", "5")),
}
_META_ROWS = [
    (1, '{"authors": ["Kuo Pelwyn", "B"], "date": "2024-05-31T23:59:59Z"}'),
    (2, '{"authors": ["C"], "date": "2024-06-01"}'),
    (3, '{"authors": "none"}'),
    (4, '{"authors": ["X kuo"], "date": "2024-06-01T00:00:01Z"}'),
    (5, '{"date": ""}'),
]


def _filter_literal(name: str, filters: SearchFilters, want: tuple[str, ...]) -> None:
    """No document of the tables has dates or authors, so these run over rows that do; the rows wanted are written out."""

    @register(name, "SELECT unnest([" + ", ".join(want) + "])::BIGINT AS doc_id")
    def run(spark, sf):
        rows = spark.createDataFrame([(i, m, "t", "p", "n", "k") for i, m in _META_ROWS], "doc_id long, metadata string, source_type string, source_path string, collection_name string, collection_type string")
        return rows.where(filters.predicate()).select("doc_id")


for _name, (_f, _w) in _LITERAL.items():
    _filter_literal(_name, _f, _w)


def _filter_query(name: str, filters: SearchFilters, where: str) -> None:
    @register(name, f"SELECT d.doc_id {_HYD} {where}")
    def run(spark, sf):
        docs = table(spark, sf, "documents")
        keyed = docs.select("doc_id", "source_id", "collection_id", "metadata")
        return hydrate(keyed.select("doc_id"), keyed, table(spark, sf, "sources"), table(spark, sf, "collections")).where(filters.predicate()).select("doc_id")


for _name, (_f, _w) in _FILTER_CASES.items():
    _filter_query(_name, _f, _w)


@register(
    "source_uri",
    f"""SELECT d.doc_id, CASE WHEN s.source_type = 'rss' THEN nullif(json_extract_string({_META}, '$.url'), '')
       WHEN s.source_type = 'markdown' AND nullif(json_extract_string({_META}, '$.url'), '') IS NOT NULL THEN json_extract_string({_META}, '$.url')
       WHEN s.source_type IN ('email', 'commit') OR starts_with(s.source_path, 'calibre://') OR starts_with(s.source_path, 'git://') THEN NULL
       WHEN s.source_type = 'code' THEN 'vscode://file' || s.source_path || ':' || coalesce(json_extract_string({_META}, '$.start_line'), '1')
       ELSE 'file://' || s.source_path END AS uri FROM documents d JOIN sources s ON s.id = d.source_id""",
)
def source_uri_query(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "sources").select(F.col("id").alias("source_id"), "source_type", "source_path"), "source_id")
    return rows.select("doc_id", source_uri(F.col("source_path"), F.col("source_type"), F.col("metadata")).alias("uri"))


@register("snippets", "SELECT doc_id, CASE WHEN length(replace(content, chr(10), ' ')) > 300 THEN substring(replace(content, chr(10), ' '), 1, 300) || '...' ELSE replace(content, chr(10), ' ') END AS snippet FROM documents")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet(F.col("content")).alias("snippet"))
