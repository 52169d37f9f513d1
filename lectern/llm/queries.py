"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm.mixing import Mixture
from lectern.llm.neighbours import REACH_BITS, NeighbourIndex, sign_vectors
from lectern.llm.newtext import new_text
from lectern.llm.packing import fill_report, pack_texts
from lectern.llm.scans import Scans
from lectern.llm.sentences import sentence_ends_table, sentences
from lectern.llm.splitting import split_items
from lectern.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def p1_found(spark, sf):
    index = NeighbourIndex(table(spark, sf, "vec_documents"), "vec_rowid", "embedding")
    return index.mutual_pairs(0.90).select(F.col("a").alias("rowid_a"), F.col("b").alias("rowid_b"))


# brute force over all pairs: for the small tables of the comparison only
ORACLE["p1_found"] = """
WITH v AS (SELECT vec_rowid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM vec_documents
           WHERE vec_rowid IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_rowid AS i, b.vec_rowid AS j, round(list_cosine_similarity(a.e, b.e), 12) AS sim FROM v a, v b WHERE a.vec_rowid <> b.vec_rowid),
t AS (SELECT i, j, sim FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 10)
SELECT x.i AS rowid_a, x.j AS rowid_b FROM t x JOIN t y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j AND x.sim >= 0.9
"""


@_query
def p1_topk(spark, sf):
    index = NeighbourIndex(table(spark, sf, "vec_documents"), "vec_rowid", "embedding")
    return index.topk().withColumnRenamed("id", "vec_rowid")


@_query
def p1_bits_topk(spark, sf):
    index = NeighbourIndex(table(spark, sf, "vec_documents_bin"), "vec_rowid", "embedding", decode=sign_vectors, reach=REACH_BITS)
    return index.topk().withColumnRenamed("id", "vec_rowid")


@_query
def p4_found(spark, sf):
    return split_items(table(spark, sf, "documents"), "doc_id", "content").where("chunk_index = 0").select("doc_id", "cut_level")


@_query
def p4_pieces(spark, sf):
    return split_items(table(spark, sf, "documents"), "doc_id", "content")


@_query
def p6_found(spark, sf):
    packed = pack_texts(table(spark, sf, "documents"))
    return packed.where("n_pieces > 1 and piece_no = 0").select("doc_id")


ORACLE["p6_found"] = "SELECT doc_id FROM documents WHERE strlen(text) > 4096"


@_query
def p6_containers(spark, sf):
    return pack_texts(table(spark, sf, "documents"))


@_query
def p6_fill(spark, sf):
    return fill_report(pack_texts(table(spark, sf, "documents")))


@_query
def p7_found(spark, sf):
    mix = Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return mix.outcome().where(~F.col("reachable")).select("source")


ORACLE["p7_found"] = """
WITH n AS (SELECT t.source, t.weight, t.max_repeats, coalesce(d.tokens, 0) AS tokens
           FROM mix_targets t LEFT JOIN (SELECT source, sum(strlen(text)) AS tokens FROM documents GROUP BY source) d ON d.source = t.source)
SELECT source FROM n
WHERE tokens * max_repeats * (SELECT sum(weight) FROM n) < weight * (SELECT sum(tokens) FROM n)
"""


@_query
def p7_mix(spark, sf):
    return Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).draws()


@_query
def p7_report(spark, sf):
    return Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).report()


@_query
def p8_found(spark, sf):
    return sentence_ends_table(table(spark, sf, "documents"))


@_query
def p8_sentences(spark, sf):
    return sentences(table(spark, sf, "documents"))


@_query
def p3_found(spark, sf):
    return new_text(table(spark, sf, "email_messages")).select("mail_id", "line_no")


@_query
def p3_new_text(spark, sf):
    """The new lines of each mail, put together again."""
    lines = new_text(table(spark, sf, "email_messages"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("mail_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("new_text"))


@_query
def p5_found(spark, sf):
    return Scans(table(spark, sf, "page_texts")).faults()


@_query
def p5_repaired(spark, sf):
    return Scans(table(spark, sf, "page_texts")).repaired()
