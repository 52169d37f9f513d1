import random

from lectern.llm import newtext
from pyspark.sql import functions as F

from lectern.llm.newtext import SuffixAutomaton, covered, inherited_lines, mark_quotes, new_text, sender_names, split_lines, strip_endings, thread_of


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        history = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        sam = SuffixAutomaton()
        for h in history:
            sam.add(h)
        words, k = [rng.choice("abc") for _ in range(15)], rng.randint(1, 6)
        grams = {tuple(h[i : i + k]) for h in history for i in range(len(h) - k + 1)}
        want = [False] * len(words)
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                want[i : i + k] = [True] * k
        assert covered(sam.lengths(words), k) == want


def test_only_what_is_fresh_is_taken_in():
    rng = random.Random(2)
    for _ in range(600):
        k, sam, grams = rng.randint(1, 4), SuffixAutomaton(), set()
        for _ in range(5):
            words = [rng.choice("abc") for _ in range(rng.randint(0, 15))]
            want = [False] * len(words)
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in grams:
                    want[i : i + k] = [True] * k
            lengths = sam.lengths(words)
            assert covered(lengths, k) == want
            sam.take_in(words, k, lengths)
            grams |= {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def kept(body, sender="Ann Bell <ann@x.example>"):
    lines = split_lines(body)
    old = strip_endings(lines, mark_quotes(lines), sender)
    return [x for x, o in zip(lines, old) if x.strip() and not o]


def test_quotes_attributions_and_wrapped_tails():
    body = "Hi,\nNew one.\n\nThanks,\nAnn\n\nOn Mon, 3 May 2021 at 10:00 \"Bo, C\"\n<bo@x.example> wrote:\n> A long line that was\nwrapped.\n> more\n\nInline answer.\n\n> rest"
    assert kept(body) == ["Hi,", "New one.", "Inline answer."]


def test_traps_stay():
    body = "On Monday I wrote: nothing about it.\nFrom: row 4 onwards they are wrong.\nThe footer says --\nand nothing else."
    assert kept(body) == body.split("\n")


def test_forward_and_signature_and_postscript():
    body = "Text.\n\n-- \nAnn Bell\nArchive desk\nTel. +00 555 12345\n\nP.S. More new text.\n\n-----Original Message-----\nFrom: Bo <bo@x.example>\nSent: 01.02.2020 10:00\nTo: Ann\nSubject: x\n\nOld text."
    assert kept(body) == ["Text.", "P.S. More new text."]


def test_threads_and_names(spark):
    subjects = spark.createDataFrame([("Re: AW: Fwd: The  maps",), ("The  maps",), (None,), (" RE:",)], "s string")
    assert [r[0] for r in subjects.select(thread_of(F.col("s"))).collect()] == ["the  maps", "the  maps", "", ""]
    assert {"ann bell", "ann", "a."} <= sender_names("Ann Bell <a@x>") and "ann bell" in sender_names('"Bell, Ann" <a@x>') and sender_names(None) == set()


LONG = "the quick brown fox jumps over the lazy dog while nobody in the old harbour was looking at the boats"


def mails(spark, rows):
    return spark.createDataFrame(rows, "mail_id long, subject string, sender string, body_text string, thread string, line string, n int")


def test_inherited_text_whatever_the_wrapping(spark, monkeypatch):
    wrapped = LONG.replace(" while", "\nwhile")
    rows = [(1, "Maps", "A <a@x>", LONG, "t", "l", 1), (2, "Re: Maps", "B <b@x>", f"My own answer.\n{wrapped}", "t", "l", 1), (3, "Other", "C <c@x>", LONG, "t", "l", 1), (4, "Maps", "A <a@x>", LONG, "t", "l", 1)]
    want = {(1, 0), (2, 0), (3, 0), (4, 0)}
    assert {(r.mail_id, r.line_no) for r in new_text(mails(spark, rows)).collect()} == want
    monkeypatch.setattr(newtext, "SEGMENT", 1)  # cut into other segments it finds the same
    assert {(r.mail_id, r.line_no) for r in new_text(mails(spark, rows)).collect()} == want


def test_segments_of_any_size_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(60):
        words = " ".join(rng.sample(texts, 2)).split()
        rows.append((i, "Hot" if i % 3 else f"s{i % 6}", f"P <p{i}@x>", "\n".join(f"own{i}x{k} " + " ".join(words[k : k + 20]) for k in range(0, 60, 20)), "t", "l", 1))
    found = []
    for size in (400, 7, 2):
        monkeypatch.setattr(newtext, "SEGMENT", size)
        found.append(sorted((r.mail_id, r.line_no, r.line) for r in new_text(mails(spark, rows)).collect()))
    assert found[0] == found[1] == found[2] and any(line == f"own{m}x{n * 20}" for m, n, line in found[0])


def test_unmarked_quotes_with_what_introduces_them_and_parts_of_lines(spark):
    rows = [(1, "Maps", "A <a@x>", LONG, "t", "l", 1), (2, "Re: Maps", "B <b@x>", f"Mine.\n\nOn Mon, 3 May 2021 at 10:00 A <a@x> wrote:\n\n{LONG}", "t", "l", 1), (3, "AW: Maps", "C <c@x>", f"Yes {LONG}\nand so on", "t", "l", 1), (4, "Re: Maps", "D <d@x>", f"> {LONG[:50]}\n> {LONG[51:]}\n\nNo.", "t", "l", 1)]
    got = {(r.mail_id, r.line_no, r.line) for r in new_text(mails(spark, rows)).collect()}
    assert got == {(1, 0, LONG), (2, 0, "Mine."), (3, 0, "Yes"), (3, 1, "and so on"), (4, 3, "No.")}
    assert inherited_lines(["a", "--", "b c"], [0, 2, 2], [True, True, False]) == ({0}, {2: "c"})


def test_a_signature_in_three_of_many_mails(spark):
    filler = spark.range(100_000).selectExpr("id + 1000 mail_id", "concat('o', id) subject", "concat('P', id, ' <p', id, '@x.example>') sender", "concat('Nothing new about item no', id, 'x.') body_text", "'t' thread", "'l' line", "1 n")
    signed = [(i, f"s{i}", "Ann Bell <ann@x.example>", f"The {w} have come.\n\nBest,\nAnn\nKeeper of the north tower\nHarbour Row, Old Quay", "t", "l", 1) for i, w in enumerate(["maps", "boats", "nets"])]
    got = new_text(mails(spark, signed).unionByName(filler))
    assert {(r.mail_id, r.line_no) for r in got.where("mail_id < 1000").collect()} == {(0, 0), (1, 0), (2, 0)}
    assert got.count() == 100_003


def test_endings_of_one_sender(spark):
    words = ["maps", "boats", "letters", "lamps", "ropes", "nets", "sails", "clocks"]
    signed = [(i, f"s{i}", "Ann Bell <ann@x.example>", f"The {w} have come.\n\nBest,\nAnn\nKeeper of the north tower\nHarbour Row, Old Quay", "t", "l", 1) for i, w in enumerate(words)]
    copies = [(100 + i, f"c{i}", "Cy <cy@x.example>", "Hi,\n\nthe door was open", "t", "l", 1) for i in range(6)]
    others = [(1000 + i, f"o{i}", f"P{i} <p{i}@x.example>", f"Nothing new about item no{i}x", "t", "l", 1) for i in range(6000)]
    got = {(r.mail_id, r.line_no) for r in new_text(mails(spark, signed + copies + others)).where("mail_id < 1000").collect()}
    assert got == {(i, 0) for i in range(8)} | {(100 + i, k) for i in range(6) for k in (0, 2)}


def test_long_notices_recur_however_wrapped(spark):
    words = ["maps", "boats", "letters", "lamps", "ropes", "nets", "sails", "clocks"]
    notice = " ".join(f"This message and clause {c} of it are meant for nobody else." for c in "abcdefghijkl").split()
    rows = []
    for i, w in enumerate(words):
        wide = 8 + i % 2
        lines = [" ".join(notice[k : k + wide]) for k in range(0, len(notice), wide)]
        assert len(lines) > 6
        rows.append((i, f"s{i}", f"P{i} <p{i}@x.example>", f"The {w} have come.\n\nBest,\nHarbour Row Ltd.\n\n" + "\n".join(lines), "t", "l", 1))
    assert {(r.mail_id, r.line_no) for r in new_text(mails(spark, rows)).collect()} == {(i, 0) for i in range(8)}


def test_all_below_a_signature_rule():
    below = "\n".join(f"Line {c} of a long signature that says this and that of her." for c in "abcdefghij")
    assert kept(f"Text.\n\nThanks,\nAnn\n\n-- \n{below}\n\nOne more. And one more.\n\nP.S. New text.\n\n> old") == ["Text.", "P.S. New text."]


def test_defined_cases(spark):
    rows = [(1, None, None, None, "t", "l", 1), (2, None, None, " \r\n ", "t", "l", 1), (3, None, None, "One.\r\nTwo.", "t", "l", 1), (None, "s", "x", "lost", "t", "l", 1), (5, "s", None, "word " * 200_000, "t", "l", 1)]
    assert {(r.mail_id, r.line_no, r.line[:4]) for r in new_text(mails(spark, rows)).collect()} == {(3, 0, "One."), (3, 1, "Two."), (5, 0, "word")}
    assert new_text(mails(spark, [])).count() == 0
