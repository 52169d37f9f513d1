"""Two-phase vector search: Hamming pool on stored sign bits, exact distance on the pool.

The bits are a table of their own, a thirty-second of the floats, written together
with them; the first phase reads nothing else, and the floats are fetched by the ids
of the pool, a bounded number that Spark broadcasts by its size. The pool is a
``TakeOrderedAndProject``: no exchange of the table. Bit i of a vector is bit i % 8,
lowest first, of byte i / 8, set where the component is above zero; NaN and null are
not. Ties go by the id. Bits and vectors of another length are in no pool; the exact
distance of such a vector is +Infinity, so they sort last in an exact scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_pool(top_k: int, filtered: bool = False) -> int:
    """Rows that the first phase keeps: wider under filters, which run after it."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return min(max(100 * top_k, 1000) if filtered else max(20 * top_k, 200), 4000)


def signature(vector: str, dim: int) -> list[Column]:
    """One long per 64 dimensions of the named column: bit i is set where component i is above zero, not where
    it is NaN; null for other lengths. Built as one SQL text, which is parsed faster than thousands of calls."""

    def word(start: int) -> Column:
        bits = [f"CASE WHEN get({vector}, {i}) > 0 AND NOT isnan(get({vector}, {i})) THEN {_signed(1 << (i - start))}L ELSE 0L END" for i in range(start, min(start + 64, dim))]
        bits = [x.replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") for x in bits]
        while len(bits) > 1:  # a shallow tree
            bits = [f"({' | '.join(bits[k : k + 2])})" for k in range(0, len(bits), 2)]
        return F.expr(f"CASE WHEN size({vector}) = {dim} THEN {bits[0]} END")

    return [word(s) for s in range(0, dim, 64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def signature_of(vector: list[float]) -> list[int]:
    return [_signed(sum(1 << i for i, x in enumerate(vector[s : s + 64]) if x > 0)) for s in range(0, len(vector), 64)]


def hamming(words: list[Column], query: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w.bitwiseXOR(F.lit(q))) for w, q in zip(words, query)])


def squared_l2(a: Column, query: list[float]) -> Column:
    """In double precision after widening; +Infinity where the lengths differ or a value is missing."""
    b = F.expr("array(" + ", ".join(f"double('{float(x)!r}')" for x in query) + ")")
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    total = F.aggregate(terms, F.lit(0.0).cast("double"), lambda s, t: s + t)
    return F.coalesce(F.when(F.size(a) == len(query), total), F.lit(float("inf")))


def hamming_topk(vectors: DataFrame, query: list[float], pool: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    fitting = vectors.where(F.size(vector_col) == len(query))
    scored = fitting.withColumn("hamming", hamming(signature(vector_col, len(query)), signature_of(query)))
    return scored.orderBy("hamming", id_col).limit(pool)


def sign_bits(vector: str, dim: int) -> Column:
    """The bits as they are stored; null for other lengths."""
    octets = []
    for start in range(0, dim, 8):
        bits = [f"CASE WHEN get({vector}, {i}) > 0 AND NOT isnan(get({vector}, {i})) THEN {1 << (i - start)} ELSE 0 END" for i in range(start, min(start + 8, dim))]
        octets.append(f"lpad(hex({' + '.join(bits)}), 2, '0')")
    return F.expr(f"CASE WHEN size({vector}) = {dim} THEN unhex(concat({', '.join(octets)})) END")


def stored_words(bits: str, dim: int) -> list[Column]:
    """Stored bits as longs, the first byte highest: for comparison with ``query_words`` only."""
    return [F.expr(f"CAST(conv(hex(substring({bits}, {k + 1}, 8)), 16, -10) AS BIGINT)") for k in range(0, (dim + 7) // 8, 8)]


def query_words(vector: list[float]) -> list[int]:
    octets = [sum(1 << (i - start) for i in range(start, min(start + 8, len(vector))) if vector[i] > 0) for start in range(0, len(vector), 8)]
    return [_signed(int.from_bytes(bytes(octets[k : k + 8]), "big")) for k in range(0, len(octets), 8)]


def bits_topk(bits: DataFrame, query: list[float], pool: int, id_col: str, bits_col: str = "embedding") -> DataFrame:
    """(id, hamming) of the pool, from the stored bits."""
    fitting = bits.where(F.octet_length(bits_col) == (len(query) + 7) // 8)
    return fitting.select(id_col, hamming(stored_words(bits_col, len(query)), query_words(query)).alias("hamming")).orderBy("hamming", id_col).limit(pool)


def exact_topk(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    return vectors.withColumn("distance", squared_l2(F.col(vector_col), query)).orderBy("distance", id_col).limit(k)


def two_phase(bits: DataFrame, vectors: DataFrame, query: list[float], top_k: int, id_col: str, filtered: bool = False, vector_col: str = "embedding") -> DataFrame:
    """The whole pool with its exact distances; filters and the cut to top_k come after it. Bits whose vector is
    gone drop out."""
    pool = bits_topk(bits, query, candidate_pool(top_k, filtered), id_col)
    return vectors.join(pool, id_col).withColumn("distance", squared_l2(F.col(vector_col), query))
