import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import fulltext, vector
from lectern.operators.filters import SearchFilters, parse_meta, stringify
from lectern.operators.fusion import HybridSearch, ranked, rrf_merge, score_text, snippet, source_uri


def test_pools():
    assert [vector.candidate_pool(k) for k in (1, 10, 100, 1000)] == [200, 200, 2000, 4000]
    assert [vector.candidate_pool(k, True) for k in (1, 10, 30, 100)] == [1000, 1000, 3000, 4000]
    assert fulltext.candidate_limit(10) == 30 and fulltext.candidate_limit(10, True) == 500
    with pytest.raises(ValueError):
        vector.candidate_pool(0)


def test_distances(spark):
    pairs = [([0.0, 0.0], [0.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 0.0], 1.0), ([3.0, 4.0], [0.0, 0.0], 25.0), ([1.0, 2.0], [1.0], math.inf)]
    for a, b, want in pairs:
        df = spark.createDataFrame([(a,)], "v array<float>")
        assert df.select(vector.squared_l2(F.col("v"), b)).first()[0] == want


def test_two_phase_orders_by_exact_distance(spark):
    rows = [(10, [1, 1, 0, 0, 0, 0, 0, 0]), (11, [0, 1, 1, 0, 0, 0, 0, 0]), (12, [0, 0, 0, 0, 1, 1, 1, 1]), (13, [-1, -1, -1, 0, 0, 0, 0, 0]), (14, [1.0]), (15, None)]
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "doc_id long, embedding array<float>")
    got = vector.two_phase(df.select("doc_id", vector.sign_bits("embedding", 8).alias("embedding")), df, [1.0, 1, 0, 0, 0, 0, 0, 0], 3, "doc_id").orderBy("distance", "doc_id").collect()
    assert got[0].doc_id == 10 and [r.distance for r in got] == sorted(r.distance for r in got) and {r.doc_id for r in got} == {10, 11, 12, 13}
    assert [r.doc_id for r in vector.exact_topk(df, [1.0, 1, 0, 0, 0, 0, 0, 0], 6, "doc_id").collect()][-2:] == [14, 15]


def test_signature_is_symmetric_and_counts_bits(spark):
    import random

    rng = random.Random(0)
    vs = [[rng.uniform(-1, 1) for _ in range(70)] for _ in range(6)]
    df = spark.createDataFrame([(v,) for v in vs], "v array<double>")
    words = df.select(*vector.signature("v", 70)).collect()
    assert [list(w) for w in words] == [vector.signature_of(v) for v in vs]
    for v in vs:
        got = [r[0] for r in df.select(vector.hamming(vector.signature("v", 70), vector.signature_of(v))).collect()]
        assert got == [sum((x > 0) != (y > 0) for x, y in zip(v, w)) for w in vs]


def test_query_syntax():
    assert fulltext.parse_query("") == [] == fulltext.parse_query('odd " quote')
    assert fulltext.parse_query("Hello foo-bar") == [["hello"], ["foo", "bar"]]


def test_fusion(spark):
    frame = lambda ids: ranked(spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "doc_id long, d double"), "d").select("doc_id", "pos")
    got = {r.doc_id: r.score for r in rrf_merge(frame([1, 2, 3]), frame([2, 4, 1]), "doc_id").collect()}
    assert set(got) == {1, 2, 3, 4} and sorted(got, key=lambda i: -got[i])[:2] in ([1, 2], [2, 1])
    assert got[1] == pytest.approx(0.7 / 61 + 0.3 / 63)
    assert rrf_merge(frame([]), frame([]), "doc_id").count() == 0
    got = {r.doc_id: r.score for r in rrf_merge(frame("ABC" and [1, 2, 3]), frame([3, 4, 5]), "doc_id").collect()}
    assert sorted(got, key=lambda i: -got[i]) == [3, 1, 2, 4, 5]


META = {
    1: '{"sender": "Ann <ann@x>", "date": "2025-01-31T10:00:00Z", "tags": ["Alpha", 3], "n": 2.50, "a.b": "dotted"}',
    2: '{"authors": ["Bo Lee", null], "date": "", "ok": true, "n": 3}',
    3: "",
    4: None,
    5: '{"authors": "Bo Lee", "sender": 7, "none": null, "n": 3.0}',
    6: "not json",
}


@pytest.fixture(scope="module")
def hydrated(spark):
    rows = [(i, "code" if i == 1 else "notes", "project" if i < 4 else "code", "email" if i == 1 else "markdown", f"/Data/File{i}.md", m) for i, m in META.items()]
    return spark.createDataFrame(rows, "doc_id int, collection_name string, collection_type string, source_type string, source_path string, metadata string").cache()


@pytest.mark.parametrize(
    "filters, want",
    [
        (SearchFilters(), {1, 2, 3, 4, 5, 6}),
        (SearchFilters(collection="code"), {4, 5, 6}),  # a type's name is never a collection's
        (SearchFilters(collection="notes"), {2, 3, 4, 5, 6}),
        (SearchFilters(source_type="email"), {1}),
        (SearchFilters(path="file1.MD"), {1}),
        (SearchFilters(path="file_"), set()),  # no wildcards
        (SearchFilters(sender="ANN"), {1}),
        (SearchFilters(author="bo"), {2}),
        (SearchFilters(date_from="2025-02-01"), {2, 3, 4, 5, 6}),
        (SearchFilters(date_to="2025-01-31"), {2, 3, 4, 5, 6}),  # a day's end is not in it
        (SearchFilters(date_to="2025-02"), {1, 2, 3, 4, 5, 6}),
        (SearchFilters(metadata={"tags": "alp"}), {1}),
        (SearchFilters(metadata={"tags": "3"}), set()),
        (SearchFilters(metadata={"n": 3}), {2, 5}),
        (SearchFilters(metadata={"n": "2.5"}), {1}),
        (SearchFilters(metadata={"ok": True}), {2}),
        (SearchFilters(metadata={"none": None}), {5}),
        (SearchFilters(metadata={"a.b": "DOT"}), {1}),
        (SearchFilters(metadata={"missing": "x"}), set()),
    ],
)
def test_filters(hydrated, filters, want):
    assert {r.doc_id for r in hydrated.where(filters.predicate()).collect()} == want
    assert filters.any() == (filters != SearchFilters())


def test_filter_values():
    assert [stringify(x) for x in (3.0, 2.5, True, None, [1, "a"], {"b": 1, "a": 2}, 1e21)] == ["3", "2.5", "true", "<nil>", "[1 a]", "map[a:2 b:1]", "1e+21"]
    assert parse_meta(["a=b=c", "d="]) == {"a": "b=c", "d": ""}
    with pytest.raises(ValueError):
        parse_meta(["novalue"])


@pytest.fixture(scope="module")
def engine(spark):
    docs = [(i, 1 if i < 6 else 2, 1, f"T{i}", "telescope " * (i % 3 + 1) + "common" if i != 9 else "foo-bar and common", None) for i in range(1, 10)]
    vecs = [(i, i if i < 9 else 99, [float((i >> b) & 1) - 0.5 for b in range(8)]) for i in range(1, 10)]
    return HybridSearch(
        spark.createDataFrame(docs, "doc_id long, source_id long, collection_id long, title string, content string, metadata string"),
        spark.createDataFrame(vecs, "vec_rowid long, document_id long, embedding array<float>"),
        spark.createDataFrame([(1, "markdown", "/a"), (2, "email", "/b")], "id long, source_type string, source_path string"),
        spark.createDataFrame([(1, "notes", "project")], "id long, collection_name string, collection_type string"),
        spark.createDataFrame(vecs, "vec_rowid long, document_id long, embedding array<float>").withColumn("embedding", vector.sign_bits("embedding", 8)),
    )


Q = [0.5, -0.5, -0.5, -0.5, -0.5, -0.5, -0.5, -0.5]


def test_filters_run_before_ranks_and_after_pools(engine):
    all_ = engine.vector_branch(Q, 3, SearchFilters()).orderBy("pos").collect()
    only = engine.vector_branch(Q, 3, SearchFilters(source_type="email")).orderBy("pos").collect()
    assert [r.pos for r in only] == [1, 2, 3][: len(only)] and {r.doc_id for r in only} <= {6, 7, 8} and all_[0].doc_id == 1


def test_orphans_take_a_place_and_vanish(engine):
    hits = engine.search("nothing-here", [float((9 >> b) & 1) - 0.5 for b in range(8)], 1).collect()
    assert hits == []  # the best vector has no document


def test_hybrid(engine):
    hits = engine.search("telescope", Q, 5).orderBy(F.desc("score"), "doc_id").collect()
    assert len(hits) == 4 and hits[0].score >= hits[-1].score  # the fifth is a vector without document
    assert engine.search("", Q, 5).count() <= 5
    with pytest.raises(ValueError):
        engine.search("x", Q, 0)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b", "a"), (2, "c", "c d e"), (3, None, "d foo bar"), (4, "", "")], "doc_id long, title string, content string")
    got = {r.doc_id: r["rank"] for r in fulltext.bm25(docs, "a", "doc_id", "title", "content").collect()}
    idf, avg = math.log((4 - 1 + 0.5) / 1.5), (3 + 4 + 3 + 0) / 4
    assert got == {1: pytest.approx(-idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)))}
    assert [r.doc_id for r in fulltext.bm25(docs, "foo-bar", "doc_id", "title", "content").collect()] == [3]
    assert fulltext.bm25(docs, "bar-foo", "doc_id", "title", "content").count() == 0
    assert fulltext.bm25(docs, '"', "doc_id", "title", "content").count() == 0
    assert fulltext.bm25(docs.limit(0), "a", "doc_id", "title", "content").count() == 0


def test_presentation(spark):
    rows = [("/v/x y.md", "markdown", '{"url": "https://u"}'), ("/v/x*~y.md", "markdown", None), ("m1", "email", None), ("calibre://1", "calibre", "{}"), ("/f.pdf", "pdf", None), ("/c.py", "code", '{"start_line": 42}'), ("r", "rss", '{"url": "https://r"}'), ("r", "rss", None)]
    df = spark.createDataFrame(rows, "p string, t string, m string")
    got = [r[0] for r in df.select(source_uri(F.col("p"), F.col("t"), F.col("m"), {"/v": "My Vault"})).collect()]
    assert got == ["https://u", "obsidian://open?vault=My+Vault&file=x%2A~y.md", None, None, "file:///f.pdf", "vscode://file/c.py:42", "https://r", None]
    assert spark.range(1).select(score_text(F.lit(0.123456)), snippet(F.lit("a\n" * 200))).first()[0] == "0.1235"


def test_stored_postings_find_what_the_texts_hold(spark):
    from lectern.operators import fulltext

    docs = [(1, "the old harbour", "a lantern in the harbour"), (2, None, "old lantern, old harbour; old"), (3, "lantern", "harbour"), (4, "", None), (5, "x", "the well-known lantern"), (6, "x", "known well")]
    df = spark.createDataFrame(docs, "doc_id long, title string, content string")
    postings, stats = fulltext.stored_postings(df, "doc_id", "title", "content"), fulltext.corpus_stats(df, "title", "content")
    for query in ("lantern", "old harbour", "well-known", "lantern-harbour", "nothing", "", 'odd "', "OLD lantern-old"):
        want = {r.doc_id: round(r["rank"], 9) for r in fulltext.bm25(df, query, "doc_id", "title", "content").collect()}
        got = {r.doc_id: round(r["rank"], 9) for r in fulltext.bm25_stored(postings, stats, query, "doc_id").collect()}
        assert got == want, query
    assert {r.doc_id for r in fulltext.bm25_stored(postings, stats, "lantern-harbour", "doc_id").collect()} == set()  # not over columns
