import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.engine import Engine
from lectern.functions import chunking, text
from lectern.functions.embedding import HashEmbedder
from lectern.functions.parsers import parse_pdf
from lectern.operators import catalog, vector
from lectern.sources import git, sqlite
from lectern.storage import Conflict


@pytest.fixture
def engine(spark, tmp_path):
    notes = tmp_path / ".above" / "notes"  # hidden folders above the root don't matter
    notes.mkdir(parents=True)
    for name in ("a", "b"):
        (notes / f"{name}.md").write_text(f"# {name}\n\nA lantern stands in the {name} harbour.")
    (notes / "private").mkdir()
    (notes / "private" / "c.md").write_text("No lantern.")
    (notes / "book.epub").write_bytes(b"not indexed outside of libraries")
    config = Config(db_path=str(tmp_path / "store"), embedding_dimensions=16, vaults=[str(notes)], vault_exclude_folders=["private"])
    told = []
    e = Engine(spark, config, HashEmbedder(16), progress=lambda name, counts: told.append((name, counts["indexed"])))
    assert e.index_all()["obsidian"]["indexed"] == 2 and told == [("obsidian", 2)]
    return e


def folders(e):
    return e.files.manifest()[1]


def test_a_change_writes_only_what_it_touches(engine):
    before = folders(engine)
    engine.set_collection_paths("obsidian", ["/p"])
    after = folders(engine)
    assert {n for n in after if after[n] != before[n]} == {"collections"}
    engine.rewrite_paths("obsidian", engine.config.vaults[0], "/moved")
    assert {n for n in folders(engine) if folders(engine)[n] != after[n]} == {"sources"}
    assert engine.files.vacuum(1) == 2 and engine.table("documents").count() == 2 and "/moved" in engine.export("obsidian").first().source


def test_two_writers_lose_nothing(engine, spark):
    other = Engine(spark, engine.config, HashEmbedder(16))
    s = engine.store()
    other.set_collection_paths("obsidian", ["/other"])  # published in between
    with pytest.raises(Conflict):
        engine.commit(catalog.delete_collection(s, "none"))
    publish, raced = engine.files.publish, []

    def race(version, manifest):
        if not raced:
            raced.append(other.rewrite_paths("obsidian", engine.config.vaults[0], "/moved"))
        publish(version, manifest)

    engine.files.publish = race
    engine.set_collection_paths("obsidian", ["/mine"])
    assert engine.collection_paths("obsidian") == ["/mine"] and "/moved" in engine.export("obsidian").first().source and raced == [2]


def test_bits_are_written_with_the_vectors_and_refilled(engine):
    assert engine.table("vec_documents_bin").count() == 2 and engine.backfill() == 0
    version, now = engine.files.manifest()
    engine.files.publish(version + 1, now | {"vec_documents_bin": engine.files.write("vec_documents_bin", engine.table("vec_documents_bin").limit(1))})
    assert engine.backfill() == 1 and engine.table("vec_documents_bin").count() == 2
    engine.delete_collection("obsidian")
    assert engine.table("vec_documents_bin").count() == 0


def test_the_first_phase_reads_no_floats(engine):
    pool = vector.bits_topk(engine.table("vec_documents_bin"), [1.0] * 16, 10, "vec_rowid")
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "array<float>" not in plan and "embedding:binary" in plan


def test_nan_and_null_set_no_bit(spark):
    v = [float("nan"), 1.0, None, 0.0, -1.0, float("inf"), 2.0, 0.5]
    df = spark.createDataFrame([(1, v), (2, [1.0])], "id long, v array<float>")
    got = df.select(vector.sign_bits("v", 8).alias("b"), vector.signature("v", 8)[0].alias("w")).collect()
    assert got[0].b == bytes([0b11100010]) and got[0].w == 0b11100010 and got[1].b is None and got[1].w is None
    assert vector.query_words([1.0] * 64) == [-1] and vector.query_words([-1.0] * 8 + [1.0] * 4) == [0x000F]


def test_truncate(spark):
    df = spark.createDataFrame([("short",), ("this is a long string",), ("äöü",), (None,)], "t string")
    assert [r[0] for r in df.select(text.truncate(F.col("t"), 10)).collect()] == ["short", "this is a ", "äöü", None]
    assert df.select(text.truncate(F.col("t"), 3)).collect()[2][0] == "ä"


def test_commit_chunks_subtract_the_real_header(spark):
    body = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([("[r/a.py] [commit: 1234567] [2024-01-02]", "s", body), ("[r/a b.py] [commit: 1234567] [2024-01-02]", "s", body), ("h", "s", "x")], "h string, s string, d string")
    got = [r[0] for r in df.select(chunking.commit_chunks(F.col("h"), F.col("s"), F.col("d"), 60, 10)).collect()]
    assert [len(c.split()) for c in got[0]] == [60, 60, 60, 60, 21] and [len(c.split()) for c in got[1]][0] == 60 and got[2] == ["h\ns\n\nx"]


def test_git_names_and_diffs(spark, tmp_path):
    repo = str(tmp_path / "r")
    os.mkdir(repo)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=A | B", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for name in ("a.py", "b.py"):
        with open(os.path.join(repo, name), "w") as f:
            f.write("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "one | two")
    rows = git.file_changes(git.commits(spark, repo), repo).orderBy("path").collect()
    assert [(r.author_name, r.subject, r.path, r.additions) for r in rows] == [("A | B", "one | two", "a.py", 1), ("A | B", "one | two", "b.py", 1)]
    assert "a/b.py" not in rows[0].diff and "+x = 1" in rows[0].diff and rows[0].diff.startswith("commit ")


def test_sqlite_reads_only_what_is_asked(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE m (id INTEGER, date INTEGER, text TEXT)")
        con.executemany("INSERT INTO m VALUES (?, ?, 'x')", [(i, i * 10) for i in range(20)])
    got = sqlite.read_table(spark, path, "m", columns=["id"], where="date > 150")
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == [16, 17, 18, 19]


def test_ocr_reads_pages_of_few_words_within_the_limits():
    import numpy as np

    class Reader:
        def pages(self, data):
            return ["few", "many words " * 10] + [""] * (len(data) - 2)

        def render(self, data, page):
            return np.zeros((2, 2, 3), np.uint8)

    assert parse_pdf(b"xx", Reader(), lambda image: "read it")[0] == (1, "read it", True)
    assert parse_pdf(b"x" * 51, Reader(), lambda image: "read it")[0] == (1, "few", False)


def test_intermediates_are_deleted(spark):
    from lectern.session import intermediates, materialize

    with intermediates(spark):
        kept = materialize(spark.range(3), "t")
        assert kept.count() == 3
        path = kept.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)
