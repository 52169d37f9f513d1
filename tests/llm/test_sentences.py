import pytest

from lectern.llm.sentences import sentence_ends, sentence_ends_table, sentence_spans, sentences

CASES = [
    ("Dr. Grodek filed it under No. 91. It rained.", ["Dr. Grodek filed it under No. 91.", "It rained."]),
    ("We kept the maps, etc. After that we left.", ["We kept the maps, etc.", "After that we left."]),
    ("The call starts at 4 p.m. Tuesday and ends. It ran at 6 a.m. Most slept.", ["The call starts at 4 p.m. Tuesday and ends.", "It ran at 6 a.m.", "Most slept."]),
    ('Loen wrote: "It is fine. Leave it there." The maps came.', ['Loen wrote: "It is fine. Leave it there."', "The maps came."]),
    ('"Where is it?" Wiel asked again. “Wait!” cried Ann, but we ran.', ['"Where is it?" Wiel asked again.', "“Wait!” cried Ann, but we ran."]),
    ("Version 9.4.66 reads a.tar.gz now. eMark 17 opens it faster.", ["Version 9.4.66 reads a.tar.gz now.", "eMark 17 opens it faster."]),
    ("Am 15. März kam er. Das gilt z. B. für alle, d. h. auch hier. Vgl. S. 35.", ["Am 15. März kam er.", "Das gilt z. B. für alle, d. h. auch hier.", "Vgl. S. 35."]),
    ("« Où est-il ? » demanda Fena. Elle a écrit : « Tout va bien. Non. » Nous partons.", ["« Où est-il ? » demanda Fena.", "Elle a écrit : « Tout va bien. Non. »", "Nous partons."]),
    ("¿Quién fue? —¿Dónde está? —preguntó Talo. La Dra. Que (véase el n.º 8) vino.", ["¿Quién fue?", "—¿Dónde está? —preguntó Talo.", "La Dra. Que (véase el n.º 8) vino."]),
    ("司書は「無事だ。触らないで。」と書いた。古い目録だ！空だ。", ["司書は「無事だ。触らないで。」と書いた。", "古い目録だ！", "空だ。"]),
    ("管理员写道：“没问题。先别动。”没有人知道。“在哪里？”管理员问道。", ["管理员写道：“没问题。先别动。”", "没有人知道。", "“在哪里？”管理员问道。"]),
    ("सूची कहाँ है? डॉ. साहब ने रखा। अरे वाह!", ["सूची कहाँ है?", "डॉ. साहब ने रखा।", "अरे वाह!"]),
    ("แฟ้มใหม่ถูกเก็บไว้ เครื่องรุ่น 6.5 อ่านได้เร็วขึ้น โคมไฟเก่า", ["แฟ้มใหม่ถูกเก็บไว้", "เครื่องรุ่น 6.5 อ่านได้เร็วขึ้น", "โคมไฟเก่า"]),
    ("A heading\n\nIt goes\nover lines. End\n\n- one\n- two\n", ["A heading", "It goes\nover lines.", "End", "- one", "- two"]),
    ("The plugin.If it is. Wheee! is a name. (It is missing.) We go.", ["The plugin.", "If it is.", "Wheee! is a name.", "(It is missing.)", "We go."]),
    ("Hmm... it may be. 10 came! 56 left.", ["Hmm... it may be.", "10 came!", "56 left."]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_golden(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


@pytest.mark.parametrize("text", [None, "", " \n\t ", "\u3000\n"])
def test_blank(text):
    assert sentence_ends(text) == []


def test_unclosed_quotes_and_depth():
    assert sentence_ends('He said "no. Then left. Again.') == [12, 23, 30]
    deep = "(" * 5000 + "a. B." + ")" * 5000
    assert sentence_ends(deep) == [len(deep)]


def test_long_text_is_linear():
    text = ('It is "fine. Really." We went on. ' * 20000).strip()
    assert len(sentence_ends(text)) == 40000


def test_cover_all_text():
    for text, _ in CASES:
        spans = sentence_spans(text)
        assert all(a < b for a, b in spans) and "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())


def test_tables(spark):
    rows = [(1, "One. Two.", "x", 5), (2, None, "x", 5), (3, "", "y", 5), (1, "One. Two.", "x", 5), (None, "Lost.", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, end_char int")
    assert sorted((r.doc_id, r.end_char) for r in sentence_ends_table(df).collect()) == [(1, 4), (1, 4), (1, 9), (1, 9)]
    assert [r.sentence for r in sentences(df).orderBy("sentence_no").collect()] == ["One.", "One.", "Two.", "Two."]
    assert sentence_ends_table(df.limit(0)).count() == 0
