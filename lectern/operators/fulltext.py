"""Full-text search: postings, phrases, BM25 over title and content.

The postings are a table of their own, with the positions of every term in every
document, in folders by a hash of the term and sorted by it there: a search reads the
folders of its terms only, and in them the row groups that may hold these. Corpus
statistics are one row beside them. ``bm25`` searches the texts themselves where no
postings are stored, in one scan and an aggregation without exchange of texts.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BUCKETS = 64
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def parse_query(query: str) -> list[list[str]]:
    """Phrases of the query: every word is one, and inner punctuation makes several tokens.
    An odd number of quotation marks is a syntax error and finds nothing, as does a blank query."""
    import regex

    if query.count('"') % 2:
        return []
    return [p for w in query.split() if (p := regex.findall(TOKEN, w.lower()))]


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(term, id, tf, dl): term counts per document over all text columns."""
    all_tokens = F.concat(*[tokens(F.col(c)) for c in text_cols])
    rows = docs.select(id_col, all_tokens.alias("t")).select(id_col, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("term", id_col, "dl").agg(F.count("*").alias("tf")).select("term", id_col, "tf", "dl")


def corpus_stats(docs: DataFrame, *text_cols: str) -> DataFrame:
    n = F.size(F.concat(*[tokens(F.col(c)) for c in text_cols]))
    return docs.agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.avg(n).alias("avg_len"))


def stored_postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(bucket, term, id, dl, at): positions over all text columns, which lie one position apart, so no phrase
    goes from one into the next. Written in folders by bucket."""
    gap = F.array(F.lit(None).cast("string"))
    parts = [tokens(F.col(c)) for c in text_cols]
    rows = docs.select(id_col, F.concat(*[x for p in parts for x in (p, gap)]).alias("t"))
    rows = rows.select(id_col, (F.size("t") - len(parts)).alias("dl"), F.posexplode("t").alias("pos", "term")).where("term is not null")
    got = rows.groupBy("term", id_col, "dl").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    bucket = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int")
    spread = got.select(bucket.alias("bucket"), "term", id_col, "dl", "at").repartition("bucket", F.pmod(F.xxhash64(id_col), F.lit(4)))
    return spread.sortWithinPartitions("bucket", "term", id_col)


def bm25_stored(postings: DataFrame, stats: DataFrame, query: str, id_col: str) -> DataFrame:
    """As ``bm25``, from stored postings and the row of ``corpus_stats``; nothing is run to plan it."""
    phrases = parse_query(query)
    if not phrases:
        return postings.select(id_col).where(F.lit(False)).withColumn("rank", F.lit(0.0))
    terms = sorted({t for p in phrases for t in p})
    mine = postings.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(terms))
    docs = mine.groupBy(id_col, "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("m"))

    def back(at: Column, k: int) -> Column:
        return F.transform(at, lambda x: x - k)

    def count(phrase: list[str]) -> Column:
        begins = F.col("m")[phrase[0]]
        for k, t in enumerate(phrase[1:], 1):
            begins = F.array_intersect(begins, back(F.col("m")[t], k))
        return F.coalesce(F.size(begins), F.lit(0))

    rows = docs.select(id_col, "dl", *[count(p).alias(f"tf_{j}") for j, p in enumerate(phrases)])
    found = rows.agg(*[F.count_if(F.col(f"tf_{j}") > 0).alias(f"df_{j}") for j in range(len(phrases))]).withColumn("_k", F.lit(1))
    whole = found.join(stats.select("n_docs", "avg_len", F.lit(1).alias("_k")), "_k")
    score, hit = F.lit(0.0), F.lit(True)
    for j in range(len(phrases)):
        idf = F.log((F.col("n_docs") - F.col(f"df_{j}") + 0.5) / (F.col(f"df_{j}") + 0.5))
        tf = F.col(f"tf_{j}").cast("double")
        score = score + F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
        hit = hit & (tf > 0)
    return rows.where(hit).withColumn("_k", F.lit(1)).join(whole, "_k").select(id_col, (-score).alias("rank"))


def _phrase_count(t: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(t, lambda x: x == phrase[0]))
    spaced = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return F.regexp_count(spaced, F.lit(f" {' '.join(phrase)}(?= )"))


def match(docs: DataFrame, phrases: list[list[str]], id_col: str, *text_cols: str) -> DataFrame:
    """(id, tf_0.., dl) of every document; a phrase lies within one column."""
    per_col = [tokens(F.col(c)) for c in text_cols]
    counted = docs.select("*", *[t.alias(f"_t{k}") for k, t in enumerate(per_col)])
    cols = [F.col(f"_t{k}") for k in range(len(per_col))]
    tf = [sum((_phrase_count(c, p) for c in cols[1:]), _phrase_count(cols[0], p)).alias(f"tf_{j}") for j, p in enumerate(phrases)]
    return counted.select(id_col, *tf, sum((F.size(c) for c in cols[1:]), F.size(cols[0])).alias("dl"))


def bm25(docs: DataFrame, query: str, id_col: str, *text_cols: str) -> DataFrame:
    """(id, rank) of the documents that hold all phrases; the more negative the better."""
    phrases = parse_query(query)
    if not phrases:
        return docs.select(id_col).where(F.lit(False)).withColumn("rank", F.lit(0.0))
    rows = match(docs, phrases, id_col, *text_cols)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf_{j}") > 0).cast("long")).alias(f"df_{j}") for j in range(len(phrases))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score, hit = F.lit(0.0), F.lit(True)
    for j in range(len(phrases)):
        df = stats[f"df_{j}"] or 0
        idf = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
        idf = idf if idf > 0 else 1e-6
        tf = F.col(f"tf_{j}").cast("double")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl))))
        hit = hit & (tf > 0)
    return rows.where(hit).select(id_col, (-score).alias("rank"))


def candidate_limit(top_k: int, filtered: bool = False) -> int:
    return (50 if filtered else 3) * top_k
