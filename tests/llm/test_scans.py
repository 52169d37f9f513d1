import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import scans
from lectern.llm.scans import Scans, _alike, canon, furniture, head_key, key_pieces, key_probes, opening, read_page

BODY = "The librarians collected the letters in the morning and\nnobody borrowed the manuscript from the museum again."


def book(n=12):
    pages = []
    for p in range(1, n + 1):
        lines = ["THE OLD HARBOUR" if p % 2 else f"{p}   LETTERS AND MAPS", "", *BODY.split("\n"), f"Page {p}"]
        pages.append("\n".join(lines))
    pages[0] = "Chapter 1\nLetters and maps\n\n" + BODY
    pages[3] = pages[3].replace("nobody borrowed", "n0body borrowed").replace("letters in", "lcttcrs in")
    pages[5] = pages[5].replace("morning and\nnobody", "morn-\ning and nobody")
    pages[7] = "THE OLD HARBOUR\n\nThey left the well-\nknown manu¬\nscript there.\nPage 8"
    return pages


SCHEMA = "page_id long, source_id long, page_number int, text string, ocr boolean, key string, n int, word string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "k", 1, "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def faults(spark):
    rows = [(100 + i, 1, i + 1, t) for i, t in enumerate(book())] + [(900 + i, 20 + i, 1, BODY + "\nThe well-known museum closed.") for i in range(6)]
    rows += [(990, 3, 1, None), (991, 3, 2, " "), (992, None, 1, BODY), (993, 4, None, BODY)]
    got = Scans(frame(spark, rows))
    return got, {(r.page_id, r.line_no, r.fault) for r in got.faults().collect()}


def test_furniture(faults):
    got = {(p, i) for p, i, f in faults[1] if f == "furniture"}
    want = {(100 + p, 0) for p in range(1, 12)} | {(100 + p, 4) for p in range(1, 12) if p not in (5, 7)} | {(105, 4), (107, 5)}
    assert got == want


def test_broken_words_but_not_spelled_hyphens(faults):
    assert {(p, i) for p, i, f in faults[1] if f == "hyphen"} == {(105, 2), (107, 3)}


def test_misread_words(faults):
    assert {(p, i) for p, i, f in faults[1] if f == "glyph"} == {(103, 2), (103, 3)}


def test_repaired_text(faults):
    rows = {r.page_id: r.paragraph for r in faults[0].repaired().collect() if 100 <= r.page_id < 110 and r.paragraph_no == 0}
    assert rows[103] == BODY.replace("\n", " ") and rows[105].startswith("The librarians collected the letters in the morning and nobody")
    assert rows[107] == "They left the well-known manuscript there."


def test_paragraphs_over_pages(spark):
    rows = [(1, 1, 1, "One goes\nover the"), (2, 1, 2, "page. It ends.\n\nTwo is bro¬"), (3, 1, 3, "ken here.\n\nThree stays."), (4, 2, 1, "Other book and")]
    got = {(r.page_id, r.paragraph_no): r.paragraph for r in Scans(frame(spark, rows)).repaired().collect()}
    assert got == {(1, 0): "One goes over the page. It ends.", (2, 1): "Two is broken here.", (3, 1): "Three stays.", (4, 0): "Other book and"}


def test_broken_words_are_corrected(spark):
    pages = ["Ann took the mus-\ncum and the lct-\nters. There was a manu¬", "scr1pt here.\n\nThe librar-\n1ans", "left."]
    rows = [(i, 1, i + 1, t) for i, t in enumerate(pages)] + [(100 + i, 20 + i, 1, BODY) for i in range(30)]
    got = [r.paragraph for r in sorted(Scans(frame(spark, rows)).repaired().where("source_id = 1").collect())]
    assert " ".join(got) == "Ann took the museum and the letters. There was a manuscript here. The librarians left."


def test_vectors_are_of_all_forms_of_a_word(spark):
    inside = "In the old harbour {} mended the nets again."
    texts = ["Nobody paints every lamp, every door.\n" + inside.format("nobody") + "\nAll was well."] * 60 + ["Nobody paints every lamp, every door.\nAll was well."] * 10
    texts += [inside.format("uobody") + "\nAll was well."] * 5
    got = Scans(frame(spark, [(i, i, 1, t) for i, t in enumerate(texts)])).misread.collect()
    assert {r.word for r in got} == {"uobody"} and len(got) == 5


def test_the_context_of_each_occurrence_decides(spark):
    """The same word is left where its neighbours are its own and corrected where they are another word's."""
    bear, hear = "the brown {} sleeps under old trees", "they often {} loud bells ringing twice"
    texts = [hear.format("hear") + "."] * 60 + [bear.format("bear") + "."] * 12 + [hear.format("bear") + "."]
    got = Scans(frame(spark, [(i, i, 1, t) for i, t in enumerate(texts)])).misread.collect()
    assert [(r.page_id, r.word, r.right) for r in got] == [(72, "bear", "hear")]


def test_keys_and_parts():
    assert canon("tlie") != canon("the") and canon("rnorning") == canon("morning") and canon("c1osed") == canon("closed") and canon("bIieb") == canon("blieb")
    assert head_key("9 2   T O O L S") == head_key("92 tools") and head_key("12   NOTES") == head_key("Notes    7")
    lines = ["Chapter 3", "Maps", "", "Body text here."]
    assert opening(lines, [0, 1, 3]) == 2 and furniture("\n".join(lines), []) == []
    assert canon("gedrnckt") == canon("gedruckt") and canon("parccl") == canon("parcel")
    words, breaks, first, last = read_page("a manu-\nscript", [])
    assert breaks[0]["sign"] == "-" and ("manuscript", 0, scans.BROKEN, 4, 1) in words and first == "a" and last is None
    assert read_page("we saw the manu-", [])[3] == (0, "manu-", ["we", "saw", "the"])


def test_misread_head_of_a_book_with_many_heads(spark):
    rng = random.Random(3)
    heads = sorted("Of " + "".join(rng.choice("bdkmprtwz") for _ in range(14)) for _ in range(90))
    texts = [f"{h}\n\n{BODY}" for h in heads for _ in range(2)]
    texts.append(f"{heads[-1][:-1]}x\n\n{BODY}")  # its true key ranks last
    got = Scans(frame(spark, [(i, 1, i + 1, t) for i, t in enumerate(texts)])).pages.collect()
    assert len(got) == 181 and all(list(r.furniture) == [0] for r in got)


def test_pieces_lead_to_every_key_that_is_alike():
    rng = random.Random(4)
    alike = 0
    for _ in range(20_000):
        a = [rng.choice("abcde") for _ in range(rng.randint(4, 40))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5 + 1)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        a, b = "".join(a), "".join(b)
        if a != b and _alike(a, b):
            alike += 1
            assert set(key_pieces(a)) & set(key_probes(b)), (a, b)
    assert alike > 5_000


def test_empty_table(spark):
    assert Scans(frame(spark, [])).faults().count() == 0


def test_no_join_sends_a_side_to_the_driver(spark, monkeypatch):
    """Heads are a few MB of Parquet where their probes are GB, so no size is small enough for a broadcast."""
    written, write = [], scans.materialize
    monkeypatch.setattr(scans, "materialize", lambda df, name: (written.append(df), write(df, name))[1])
    got = Scans(frame(spark, [(100 + i, 1, i + 1, t) for i, t in enumerate(book())]))
    plans = "\n".join(df._jdf.queryExecution().executedPlan().toString() for df in (*written, got.faults(), got.repaired()))
    assert "SortMergeJoin" in plans and "Broadcast" not in plans


def test_contexts_are_taken_of_few_pages_at_a_time(monkeypatch):
    texts = ["the brown bear sleeps under old trees"] * 60 + ["the brown dear sleeps under old trees"]
    words = [t.split() for t in texts]
    batch = pa.record_batch({
        "page_id": pa.array(range(len(texts)), pa.int64()), "words": pa.array(words), "kinds": pa.array([[scans.WORD] * len(w) for w in words], pa.list_(pa.int32())),
        **{c: pa.array([[0] * len(w) for w in words], pa.list_(pa.int32())) for c in ("lines", "cuts", "nexts")},
    })
    every = np.full(scans.BLOOM // 8, 255, np.uint8)
    run = lambda: [b for b in scans.surroundings(iter([batch]), np.ones(scans.SKETCH, "f4"), every, every)]
    whole = run()
    monkeypatch.setattr(scans, "PAGES_AT_ONCE", 8)
    parts = run()
    assert max(b.num_rows for b in parts) <= 8 * 7 and len(parts) == 9  # eight lists of pages and the sums
    rows = lambda found, c: sorted(r for b in found for r in zip(*(b.column(k).to_pylist() for k in c)) if r[1] is not None)
    assert rows(parts, ("page_id", "x", "word")) == rows(whole, ("page_id", "x", "word"))
    assert rows(parts, ("word", "v")) == rows(whole, ("word", "v"))
