import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking, code, dates, embedding, parsers, paths, text


def col(spark, values, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(fn(F.col("v"))).collect()]


def test_words_and_windows(spark):
    assert col(spark, ["", "hello", "hello world", "  spaced   out  ", "a b", None], text.word_count) == [0, 1, 2, 2, 2, 0]
    assert col(spark, ["", " \n"], lambda c: chunking.windows(c, 10, 2)) == [[], []]
    assert col(spark, [" a  b c "], lambda c: chunking.windows(c, 10, 2)) == [[" a  b c "]]
    assert col(spark, ["a b c d e f g h i j"], lambda c: chunking.windows(c, 5, 2)) == [["a b c d e", "d e f g h", "g h i j"]]
    assert col(spark, ["", None], lambda c: chunking.plain_chunks(c, 5, 2)) == [[""], [""]]


def test_windows_agree_with_python_and_cover(spark):
    rng = random.Random(5)
    for _ in range(12):
        t = " ".join(f"w{i}" for i in range(rng.randint(0, 60)))
        size, overlap = rng.randint(1, 20), rng.randint(-2, 22)
        got = col(spark, [t], lambda c: chunking.windows(c, size, overlap))[0]
        assert got == chunking.py_windows(t, size, overlap)
        s, o = chunking.guard(size, overlap)
        if len(got) > 1:
            assert got[0].split() + [w for g in got[1:] for w in g.split()[o:]] == t.split()


def test_markdown_chunks(spark):
    md = "pre\n# Introduction\nIntro.\n## Background\nSome.\n## Methods\n### Data Collection\nDone."
    got = chunking.chunk_markdown(md, "T", 500, 50)
    assert [c["text"].split("]")[0] for c in got] == ["pre", "[Introduction", "[Introduction > Background", "[Introduction > Methods > Data Collection"]
    big = chunking.chunk_markdown("# Heading\n" + "word " * 30, "T", 10, 2)
    assert len(big) > 2 and all(c["text"].startswith("[Heading] ") for c in big) and [c["chunk_index"] for c in big] == list(range(len(big)))
    assert len(chunking.chunk_markdown("", "T", 10, 2)) == 1 and chunking.chunk_markdown("# A\n# B\n", "T", 10, 2)[0]["text"] == "# A\n# B"
    assert len(chunking.chunk_markdown("# very long heading of many words\n" + "w " * 20, "T", 3, 2)) > 0  # ends
    rows = spark.createDataFrame([(md, "T"), (None, None)], "c string, t string").select(F.inline(chunking.markdown_chunks(500, 50)("c", "t"))).collect()
    assert len(rows) == 5


def test_mail_chunks():
    assert chunking.chunk_email("Hello", "Short body.", 100, 10) == [{"text": "Short body.", "title": "Hello", "metadata": "", "chunk_index": 0}]
    assert chunking.chunk_email("Subject", "", 10, 2)[0]["text"] == "Subject: Subject" and chunking.chunk_email("", "", 10, 2)[0]["title"] == "(no subject)"
    paragraphs = "\n\n".join(" ".join(["word"] * 20) for _ in range(3))
    assert len(chunking.chunk_email("S", paragraphs, 25, 5)) == 3 and len(chunking.chunk_email("S", "w " * 100, 25, 5)) == 5


def test_mail_cleaning(spark):
    body = "New.\n\nOn Mon, 3 May 2021 Ann wrote:\n> old\nrest"
    assert col(spark, [body, "> q\nkept\n\n\n\nx"], text.strip_quoted_replies) == ["New.", "kept\n\nx"]
    assert col(spark, ["Text\n-- \nAnn", "Text\nSent from my iPhone 5\nx", "a -- b"], text.strip_signature) == ["Text", "Text", "a -- b"]


def test_note_markup(spark):
    src = "See ![[img.png]] and [[Target|shown]] or [[Other]]. #tag #a/b\n# Head\n`#no` ```\n#no\n```"
    assert col(spark, [src], lambda c: text.convert_wikilinks(text.strip_embeds(c)))[0].startswith("See  and shown (Target) or Other.")
    assert col(spark, [src], text.inline_tags) == [["tag", "a/b"]]
    note = parsers.parse_markdown("---\ntitle: My Note\ntags: [x, y]\ndate: 2024-01-02\n---\nBody [[L]] #z", "stem")
    assert (note["title"], note["tags"], note["links"], note["body"]) == ("My Note", ["x", "y", "z"], ["L"], "Body L #z") and "2024-01-02T00:00:00Z" in note["frontmatter"]
    bad = parsers.parse_markdown("---\na: [\n---\nBody", "stem")
    assert bad["title"] == "stem" and bad["body"].startswith("---")


@pytest.mark.parametrize("html, want", [("<p>Hello, <b>world</b>!</p>", "Hello,\nworld\n!"), ("Text<script>var a='</p>';</script>More", "Text\nMore"), ("", ""), ("  \n ", ""), (None, ""), ("<title>T</title>a &amp; b", "T\na & b")])
def test_html(html, want):
    assert parsers.html_to_text(html) == want


def test_office_and_books():
    import io
    import zipfile

    def pack(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, c in files.items():
                z.writestr(n, c)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space='preserve'>  World</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>"
    assert parsers.parse_docx(pack({"word/document.xml": doc})) == "Hello  World\nTwo\tx"
    assert parsers.parse_docx(b"no zip") == "" == parsers.parse_docx(pack({"x": "y"}))
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="b"/><itemref idref="c"/></spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    book = pack({"META-INF/container.xml": container, "O/p.opf": opf, "O/a.xhtml": "<p>One</p>", "O/c.xhtml": "<p>Three</p>"})
    assert parsers.parse_epub(book) == [(1, "One"), (3, "Three")] and parsers.parse_epub(b"") == []


def test_pdf_adapter():
    class Fake(parsers.PdfReader):
        def pages(self, data):
            return [" " + "word " * 20, "few", None, ""]

        def render(self, data, page):
            return np.full((2, 2, 3), 255, np.uint8)

    assert parsers.parse_pdf(b"x", Fake()) == [(1, ("word " * 20).strip(), False), (2, "few", False)]
    assert parsers.parse_pdf(b"x", Fake(), ocr=lambda a: "read")[1:] == [(2, "read", True), (4, "read", True)]
    assert parsers.binarize(np.array([[[0, 0, 0], [255, 255, 255], [127, 127, 127], [128, 128, 128]]], np.uint8)).tolist() == [[0, 255, 0, 255]]


def test_code():
    src = "import os\n\n@deco\ndef hello():\n    return 1\n\n\nclass Greeter:\n" + "\n".join(f"    def m{i}(self):\n        a = {i}\n        b = {i}\n        c = a + b\n        return c\n" for i in range(3)) + "\nX = 1\n"
    whole = code.code_blocks(src, "python")
    assert [(b.symbol, b.symbol_type) for b in whole] == [("(module)", "module_top"), ("hello", "function"), ("Greeter", "class"), ("(module)", "module_top")] and whole[1].text.startswith("@deco")
    parts = code.code_blocks(src, "python", 20, 5)
    assert [(b.symbol, b.symbol_path) for b in parts if b.symbol.startswith("m")] == [("m0", "Greeter"), ("m1", "Greeter"), ("m2", "Greeter")]
    assert [b.symbol_type for b in code.code_blocks("\n".join(f"x{i} = {i}" for i in range(20)), "python")] == ["module_top"]
    assert len(code.code_blocks("w " * 300, "plaintext", 100, 10)) >= 2
    assert [b.symbol for b in code.code_blocks('resource "aws_instance" "web" {\n a = 1\n}\nvariable "region" {\n}\n', "hcl")] == ["resource aws_instance web", "variable region"]
    assert {b.symbol for b in code.code_blocks("export function f() {\n}\nclass C {\n}\n", "typescript")} == {"f", "C"}


def _class_of(language: str) -> str:
    head, method, tail = {
        "typescript": ("export class OrderService {\n  private size = 1;", "  async m{i}(a: number): Promise<number> {{\n    if (a > {i}) {{\n      return a;\n    }}\n    return {i};\n  }}", "}"),
        "java": ("public class OrderService {\n  private int size = 1;", "  @Override\n  public int m{i}(int a) throws Error {{\n    for (int k = 0; k < a; k++) {{ a += {i}; }}\n    return a;\n  }}", "}"),
        "csharp": ("class OrderService {\n  int size;", "  public async Task<int> m{i}(int a) {{\n    using (a) {{ a += {i}; }}\n    return a;\n  }}", "}"),
        "rust": ("impl OrderService {", "    pub fn m{i}(&self, a: i32) -> i32 {{\n        if a > {i} {{ return a; }}\n        a + {i}\n    }}", "}"),
        "cpp": ("class OrderService {\n public:", "  int m{i}(int a) const {{\n    while (a > {i}) {{ a--; }}\n    return a;\n  }}", "};"),
        "ruby": ("class OrderService", "  def m{i}(a)\n    a + {i} + 1 + 2 + 3\n  end", "end"),
    }[language]
    return "\n".join([head, *(method.format(i=i) for i in range(3)), tail])


@pytest.mark.parametrize("language", ["typescript", "java", "csharp", "rust", "cpp", "ruby"])
def test_methods_of_large_classes_are_blocks(language):
    src = _class_of(language)
    parts = code.code_blocks(src, language, 30, 4)
    assert [(b.symbol, b.symbol_type, b.symbol_path) for b in parts if b.symbol.startswith("m")] == [(f"m{i}", "function", "OrderService") for i in range(3)]
    assert [b.symbol for b in code.code_blocks(src, language, 500, 50)] == ["OrderService"]


def test_paths(spark):
    assert col(spark, ["a/b.md", ".hid/x", "a/.b", "./x", "a.b/c"], paths.is_hidden) == [False, True, True, True, False]
    assert col(spark, ["a.md", "b.PDF", "c.docx", "d.html", "e.HTM", "f.txt", "g.csv", "h.epub", "i.png", "none"], paths.source_type) == ["markdown", "pdf", "docx", "html", "html", "plaintext", "plaintext", "epub", "", ""]
    assert col(spark, ["x/a.py", "b.tsx", "Dockerfile", "d/Makefile", "x.bin"], paths.code_language) == ["python", "tsx", "dockerfile", "plaintext", ""]
    assert col(spark, ["go.sum", "a/node_modules/b.js", "src/dist.py", "vendor/x.go", "x.egg-info/y.py"], paths.is_excluded) == [True, True, False, True, False]


def test_dates(spark):
    assert col(spark, [0, None, 634326708205419183], dates.ticks_to_iso, "long") == ["", "", "2011-02-07T10:20:20Z"]
    assert col(spark, ["2011-02-07T10:20:20Z", "1970-01-01", "junk", None], dates.iso_to_ticks) == [634326708200000000, 621355968000000000, 0, 0]
    assert col(spark, [0.0, 1.9], dates.seconds_to_iso, "double") == ["", "1970-01-01T00:00:01Z"]
    assert col(spark, ["1.5", "2020-01-02 03:04:05", "2020-01-02", "x"], dates.feed_seconds) == [1.5, 1577934245.0, 1577923200.0, 0.0]


def test_codec_and_embedding(spark):
    v = [1.0, 2.5, -3.140000104904175, 0.0]
    assert len(embedding.serialize(v)) == 16 and embedding.deserialize(embedding.serialize(v) + b"x") == v and embedding.serialize([]) == b""
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, content string")
    got = {r.doc_id: list(r.embedding) for r in embedding.embed(df, embedding.HashEmbedder(8)).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] == [0.0] * 8


def test_hosts():
    import http.server
    import json
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def _say(self, data):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(data).encode())

        def do_GET(self):
            self._say({"models": [{"name": "m:latest"}]})

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            self._say({"embeddings": [[float(len(t))] for t in texts]})

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"127.0.0.1:{server.server_port}"
    assert embedding.resolve_host(["127.0.0.1:1", host], "m") == f"http://{host}" and embedding.resolve_host([], "m", "h:1") == "http://h:1"
    assert embedding.resolve_host([host], "other", default="http://d") == "http://d"
    assert embedding.HttpEmbedder(host, "m", batch=2)(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    server.shutdown()
