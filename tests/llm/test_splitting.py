import random

import pytest

from lectern.llm.splitting import Units, pieces, split_items


def rebuilt(text, limit, overlap):
    got = pieces(text, limit, overlap)
    return "".join(text[a + (overlap if k else 0) : b] for k, (a, b) in enumerate(got)), got


def test_round_trip_on_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "x" * rng.randint(1, 90), ". ", "\n", "\n\n", "\r\n", "é", "。", " "]) for _ in range(rng.randint(1, 120)))
        limit = rng.randint(20, 200)
        overlap = rng.randint(0, limit // 2)
        back, got = rebuilt(text, limit, overlap)
        assert back == text
        assert all(0 < b - a <= limit for a, b in got)
        assert all(c == b - overlap for (_, b), (c, _) in zip(got, got[1:]))


def test_cuts_at_paragraphs_where_it_can():
    text = "\n\n".join("word " * 30 for _ in range(40))
    assert all(text[b - 2 : b] == "\n\n" for _, b in pieces(text, 2000, 200)[:-1])


@pytest.mark.parametrize(
    "text, want",
    [("a" * 1999 + "\n \t\n" + "b" * 2000, "paragraph"), ("a" * 1500 + "\n" + "b" * 1500, "line"), ("It is so. " * 300, "sentence"), ("word " * 500, "word"), ("x" * 2001, "none"), ("a" * 1500 + "\r\n\r\n" + "b" * 600, "paragraph")],
)
def test_cut_level(text, want):
    assert Units(text).cut_level(2000) == want


def test_table(spark):
    rows = [(1, "short", 9), (2, None, 9), (3, "", 9), (4, "word " * 1000, 9), (4, "word " * 1000, 9), (5, " " * 2500, 9), (None, "y" * 3000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, content string, chunk_index int")
    out = split_items(df, "doc_id", "content")
    assert {r.doc_id for r in out.collect()} == {4, 5}
    assert out.where("doc_id = 4 and chunk_index = 0").count() == 2
    assert {r.doc_id for r in split_items(df, "doc_id", "content", keep_short=True).collect()} == {1, 4, 5}
    assert split_items(df.limit(0), "doc_id", "content").count() == 0
    with pytest.raises(ValueError):
        split_items(df, "doc_id", "content", 100, 100)


def test_very_long():
    text = "a b. " * 200_000
    assert rebuilt(text, 2000, 200)[0] == text
