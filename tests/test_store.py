import json
import os
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from lectern.config import Config, expand, unexpand
from lectern.engine import Engine
from lectern.operators import catalog, ingest
from lectern.operators.filters import SearchFilters
from lectern.sources import git, sqlite


@pytest.fixture
def store(spark):
    return catalog.Store(
        spark.createDataFrame([(1, "a", "project"), (2, "b", "system")], "id long, collection_name string, collection_type string"),
        spark.createDataFrame([(1, 1, "markdown", "/a", "h1", None, None), (2, 1, "pdf", "/b", None, "x", None), (3, 2, "commit", "git:///r#abc", None, None, None)], "id long, collection_id long, source_type string, source_path string, file_hash string, file_modified_at string, last_indexed_at timestamp"),
        spark.createDataFrame([(1, 1, 1, "T", "c"), (2, 1, 1, None, "c"), (3, 2, 1, "T", "c"), (4, 3, 2, "U", "c")], "doc_id long, source_id long, collection_id long, title string, content string"),
        spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0]), (3, 3, [1.0]), (4, 99, [1.0])], "vec_rowid long, document_id long, embedding array<float>"),
    )


def test_statistics(store):
    got = {r.collection_name: (r.source_count, r.chunk_count) for r in catalog.collection_stats(store).collect()}
    assert got == {"a": (2, 3), "b": (1, 1)}
    assert [r.title for r in catalog.sample_titles(store, 1, 5).collect()] == ["T"]
    assert catalog.status(store).first().asDict() == {"collections": 2, "sources": 3, "last_indexed": None, "chunks": 4}


def test_deletion_reaches_documents_and_vectors(store, spark):
    left = catalog.delete_sources(store, spark.createDataFrame([(1,)], "id long"))
    assert (left.sources.count(), left.documents.count(), left.vectors.count()) == (2, 2, 2)
    same = catalog.delete_sources(store, spark.createDataFrame([], "id long"))
    assert (same.sources.count(), same.documents.count(), same.vectors.count()) == (3, 4, 4)
    gone = catalog.delete_collection(store, "a")
    assert (gone.collections.count(), gone.sources.count(), gone.documents.count()) == (1, 1, 1)
    assert {r.vec_rowid for r in gone.vectors.collect()} == {4} == {r.vec_rowid for r in catalog.orphans(store).collect()}


def test_paths_and_export(store):
    got = {r.source_path for r in catalog.rewrite_paths(store.sources, "/", "/new/").collect()}
    assert got == {"/new/a", "/new/b", "git:///r#abc"}
    out = {r.id: json.loads(r.source) for r in catalog.export_collection(store, "a").collect()}
    assert out == {1: {"id": 1, "source_type": "markdown", "source_path": "/a", "file_hash": "h1"}, 2: {"id": 2, "source_type": "pdf", "source_path": "/b", "file_modified_at": "x"}}


def test_upsert_keeps_ids(store, spark):
    new = spark.createDataFrame([(1, "markdown", "/a", "h2", None, None), (1, "pdf", "/c", "h", None, None)], "collection_id long, source_type string, source_path string, file_hash string, file_modified_at string, last_indexed_at timestamp")
    got = {r.source_path: (r.id, r.file_hash) for r in catalog.upsert_sources(store.sources, new).collect()}
    assert got == {"/a": (1, "h2"), "/b": (2, None), "git:///r#abc": (3, None), "/c": (4, "h")}


def test_change_detection(store, spark):
    files = spark.createDataFrame([(1, "/a", "h1"), (1, "/b", "h9"), (1, "/n", "h")], "collection_id long, source_path string, file_hash string")
    assert {r.source_path for r in ingest.changed_files(files, store.sources).collect()} == {"/b", "/n"}
    assert ingest.changed_files(files, store.sources, force=True).count() == 3
    assert {r.source_path for r in ingest.not_indexed(files, store.sources).collect()} == {"/n"}


def test_prune_rules(store, spark):
    there = spark.createDataFrame([("/a",)], "source_path string")
    stale = ingest.stale_sources(store.sources, there, skip_uris=True)
    assert {r.source_path for r in stale.collect()} == {"/b"}
    assert ingest.prune_result(store.sources, stale, skip_uris=True).first().asDict() == {"checked": 2, "pruned": 1}
    assert ingest.stale_sources(store.sources, there, readable=False).count() == 0
    again = store.sources.join(stale.select("id"), "id", "left_anti")
    assert ingest.stale_sources(again, there, skip_uris=True).count() == 0


def test_watermarks(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-02T00:00:00Z",), (None,)], "date string")
    assert ingest.since_watermark(rows, "2024-01-01T00:00:00Z").count() == 1 and ingest.since_watermark(rows, None).count() == 3
    assert ingest.since_watermark(rows, "2024-01-02T00:00:00Z", allow_late=True).count() == 3
    assert ingest.parse_watermarks("") == {} == ingest.parse_watermarks("junk") == ingest.parse_watermarks("{bad")
    assert ingest.parse_watermarks('{"/a": "1", "/b": "2"}') == {"/a": "1", "/b": "2"} and ingest.parse_watermarks("git:/path:x:abc") == {"/path:x": "abc"}
    changed = spark.createDataFrame([("x",), ("y",)], "path string")
    assert {(r.path, r.action) for r in ingest.classify_diff(changed, changed.where("path = 'x'")).collect()} == {("x", "index"), ("y", "delete")}


def test_merged_results(spark):
    rows = spark.createDataFrame([(5, 3, 1, 9, []), (2, 1, 0, 3, ["oops"])], "indexed long, skipped long, errors long, total_found long, messages array<string>")
    assert tuple(catalog.result_merge(rows).first()) == (7, 4, 1, 12, ["oops"])


def test_engine_indexes_once_and_prunes(spark, tmp_path):
    notes = tmp_path / "notes"
    (notes / ".hidden").mkdir(parents=True)
    (notes / "a.md").write_text("---\ntitle: Alpha\n---\n# Head\nThe telescope is old.\n## Sub\nMore.")
    (notes / "b.txt").write_text("plain words about a kettle")
    (notes / "blank.txt").write_text("  ")
    (notes / ".hidden" / "c.md").write_text("no")
    (notes / "pic.png").write_bytes(b"x")
    e = Engine(spark, Config(db_path=str(tmp_path / "store"), embedding_dimensions=64))
    assert e.index_files("notes", [str(notes), str(tmp_path / "missing")])["indexed"] == 2
    assert e.index_files("notes", [str(notes)])["indexed"] == 0  # nothing twice; blank files are tried again
    before = {r.source_path: r.id for r in e.table("sources").collect()}
    (notes / "b.txt").write_text("plain words about a lantern")
    assert e.index_files("notes", [str(notes)])["indexed"] == 1
    assert {r.source_path: r.id for r in e.table("sources").collect()} == before
    assert e.search_results("lantern", top_k=1)[0]["content"].endswith("lantern")
    assert [r["title"] for r in e.search_results("telescope", top_k=5, filters=SearchFilters(source_type="markdown"))][0] == "Alpha"
    assert e.collection_info("notes")["chunk_count"] == 3 == e.table("vec_documents").count()
    (notes / "a.md").unlink()
    assert e.prune_files("notes") == {"checked": 2, "pruned": 1} and e.prune_files("missing") == {"checked": 0, "pruned": 0}
    e.delete_collection("notes")
    assert e.list_collections() == [] and e.table("documents").count() == 0


def test_engine_indexes_code_with_history(spark, tmp_path):
    repo = tmp_path / "one"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.py").write_text("def hello():\n    return 'telescope'\n")
    (repo / "b.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "First")
    e = Engine(spark, Config(db_path=str(tmp_path / "store"), embedding_dimensions=64))
    assert e.index_code("anvil", [str(tmp_path)], history=True)["indexed"] == 3
    assert e.index_code("anvil", [str(tmp_path)], history=True) == {"indexed": 0, "skipped": 0, "errors": 0, "total_found": 0}
    hit = e.search_results("telescope", top_k=1, filters=SearchFilters(source_type="code"))[0]
    assert hit["content"].startswith("[a.py:1-2] [python] [function: hello]\n") and hit["source_uri"] == f"vscode://file{repo}/a.py:1"
    (repo / "b.py").unlink()
    (repo / "a.py").write_text("def hello():\n    return 'lantern'\n")
    run("commit", "-qam", "Second")
    assert e.index_code("anvil", [str(tmp_path)], history=True)["indexed"] == 2
    assert {r.source_path.rsplit("/", 1)[1][:4] for r in e.table("sources").collect()} == {"a.py", "one#"}


def test_engine_indexes_mail_and_books(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "mail_index.dat")
    con.executescript("CREATE TABLE MailItems (id INTEGER PRIMARY KEY, folder INTEGER, date INTEGER, subject TEXT, messageId TEXT, preview TEXT); INSERT INTO MailItems VALUES (1, 7, 634326708205419183, 'Hi', '<m1>', 'about a lantern'), (2, 7, 634326708205419184, 'Yo', '<m2>', 'x'); CREATE TABLE MailAddresses (parentId INTEGER, type INTEGER, displayName TEXT, address TEXT, position INTEGER)")
    con.close()
    lib = tmp_path / "lib"
    lib.mkdir()
    con = sqlite3.connect(lib / "metadata.db")
    con.executescript("CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, path TEXT, pubdate TEXT, last_modified TEXT, series_index REAL); INSERT INTO books VALUES (1, 'Maps', 'A/Maps (1)', '2020', NULL, 1.0)")
    for link, target, key, value in (("authors", "authors", "author", "name"), ("tags", "tags", "tag", "name"), ("languages", "languages", "lang_code", "lang_code"), ("series", "series", "series", "name"), ("publishers", "publishers", "publisher", "name"), ("ratings", "ratings", "rating", "rating")):
        con.executescript(f"CREATE TABLE books_{link}_link (id INTEGER PRIMARY KEY, book INTEGER, {key} INTEGER); CREATE TABLE {target} (id INTEGER PRIMARY KEY, {value} TEXT); INSERT INTO books_{link}_link VALUES (1, 1, 5); INSERT INTO {target} VALUES (5, '{link}5')")
    con.executescript("CREATE TABLE identifiers (id INTEGER PRIMARY KEY, book INTEGER, type TEXT, val TEXT); INSERT INTO identifiers VALUES (1, 1, 'isbn', 'old'), (2, 1, 'isbn', 'new'); CREATE TABLE comments (id INTEGER PRIMARY KEY, book INTEGER, text TEXT); INSERT INTO comments VALUES (1, 1, '<p>About <b>maps</b></p>'); CREATE TABLE data (id INTEGER PRIMARY KEY, book INTEGER, format TEXT, name TEXT)")
    con.close()
    e = Engine(spark, Config(db_path=str(tmp_path / "store"), embedding_dimensions=64))
    assert e.index_mail([str(tmp_path)])["indexed"] == 2 and e.index_mail([str(tmp_path)])["indexed"] == 0
    assert e.index_books([str(lib)])["indexed"] == 1 and e.index_books([str(lib)])["indexed"] == 0
    book = e.search_results("maps", top_k=1, filters=SearchFilters(author="authors5"))[0]
    assert book["title"] == "Maps (description)" and book["metadata"]["identifiers"] == {"isbn": "new"} and book["metadata"]["calibre_id"] == 1
    assert e.search_results("lantern", top_k=1, filters=SearchFilters(collection="email"))[0]["source_path"] == "email://<m1>"
    e.config.mail_path = str(tmp_path)
    con = sqlite3.connect(tmp_path / "mail_index.dat")
    con.executescript("DELETE FROM MailItems WHERE id = 2")
    con.close()
    assert e.prune("email") == {"checked": 2, "pruned": 1}
    e.config.mail_path = str(tmp_path / "missing")
    assert e.prune("email") == {"checked": 0, "pruned": 0}  # unreadable is not empty
    e.set_collection_paths("email", ["/p"])
    assert e.collection_paths("email") == ["/p"] and e.rewrite_paths("email", "email://", "mail://") == 1 and "mail://<m1>" in e.export("email").first().source
    with pytest.raises(KeyError):
        e.collection_paths("none")


def test_index_all_goes_on_after_errors(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("some words")
    e = Engine(spark, Config(db_path=str(tmp_path / "store"), embedding_dimensions=64, projects={"proj": [str(tmp_path / "p")]}, repositories={"repo": [str(tmp_path / "none")]}))
    got = e.index_all()
    assert got["repo"]["errors"] == 1 and got["proj"]["indexed"] == 1


def test_config_paths():
    c = Config(vaults=["/a"], projects={"p": ["/x"]})
    assert c.add_paths("obsidian", ["/b", "/a"]) == ["/a", "/b"] and c.remove_paths("p", ["/x"]) == [] and c.update_path("obsidian", "/a", "/z") == ["/z", "/b"] == c.list_paths("obsidian")
    with pytest.raises(KeyError):
        c.list_paths("none")


def test_config(tmp_path):
    path = str(tmp_path / "c" / "config.json")
    assert Config.load(path) == Config()
    c = Config(chunk_size=300, vaults=["~/v"], unknown={"later": [1]})
    c.save(path)
    assert Config.load(path) == c
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "old.json").write_text('{"reindex_interval_hours": 2, "chunk_size": "no"}')
    assert Config.load(str(tmp_path / "bad.json")) == Config() and Config.load(str(tmp_path / "old.json")).reindex_interval_minutes == 120
    assert expand("~/x") == os.path.expanduser("~/x") and unexpand(expand("~/x")) == "~/x" and expand("/~") == "/~"
    assert Config(chunk_size=1).problems() and not Config().problems() and not Config(disabled_collections=["x"]).enabled("x")


def test_git(spark, tmp_path):
    repo = tmp_path / "r" / "one"
    repo.mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.py").write_text("x = 1\n")
    (repo / "go.sum").write_text("no\n")
    run("add", "-A")
    run("commit", "-qm", "First")
    mark = git.head(str(repo))
    (repo / "a.py").write_text("x = 2\n")
    run("commit", "-qam", "chore: second")
    assert git.resolve([str(tmp_path / "r")]) == [str(repo)] and git.discover(str(repo)) == [str(repo)]
    with pytest.raises(NotADirectoryError):
        git.discover(str(repo / "a.py"))
    assert {r.path for r in git.tracked(spark, str(repo)).collect()} == {"a.py"}
    assert git.changed_since(str(repo), mark) == ["a.py"] and git.changed_since(str(repo), "0" * 40) is None and git.changed_since(str(repo), None) is None
    assert git.read_files(git.tracked(spark, str(repo)), str(repo)).first().language == "python"
    log = git.commits(spark, str(repo))
    assert [r.subject for r in log.collect()] == ["First", "chore: second"] and git.not_blacklisted(log, ["chore"]).count() == 1
    changes = git.file_changes(log.where("subject <> 'First'"), str(repo)).collect()
    assert [(r.path, r.additions, r.deletions) for r in changes] == [("a.py", 1, 1)] and "x = 2" in changes[0].diff


def test_sqlite_mail_account(spark, tmp_path):
    def db(name, *sql):
        con = sqlite3.connect(tmp_path / name)
        for s in sql:
            con.execute(s)
        con.commit()
        con.close()

    db("mail_index.dat", "CREATE TABLE MailItems (id INTEGER PRIMARY KEY, folder INTEGER, date INTEGER, subject TEXT, messageId TEXT, preview TEXT)", "INSERT INTO MailItems VALUES (1, 7, 634326708205419183, 'Hi', '<m1>', 'pre'), (2, 9, 0, 'No body', NULL, 'preview text'), (3, 7, 0, '', NULL, ' ')",
       "CREATE TABLE MailAddresses (parentId INTEGER, type INTEGER, displayName TEXT, address TEXT, position INTEGER)", "INSERT INTO MailAddresses VALUES (1, 4, 'Bo', 'bo@x', 1), (1, 4, '', 'al@x', 0), (1, 5, 'Cy', 'cy@x', 0), (1, 1, 'Ann', 'ann@x', 0)")
    db("mail_fti.dat", "CREATE TABLE LocalMailsIndex3 (id INTEGER, partName TEXT, content TEXT)", "INSERT INTO LocalMailsIndex3 VALUES (1, '2', 'second'), (1, '1', 'First.\n-- \nsig'), (1, 'x', 'no number'), (1, '0', '  ')")
    assert sqlite.mail_accounts(str(tmp_path)) == [str(tmp_path)]
    got = {r.id: r for r in sqlite.read_mails(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].body, got[1].sender, list(got[1].recipients), got[1].date, got[1].folder) == ("First.", "Ann <ann@x>", ["al@x", "Bo <bo@x>", "Cy <cy@x>"], "2011-02-07T10:20:20Z", "")
    assert got[2].body == "preview text" and len(got[2].message_id) == 32
    assert sqlite.read_table(spark, str(tmp_path / "mail_fti.dat"), "LocalMailsIndex3", 2).count() == 4
    with pytest.raises(Exception):
        sqlite.read_table(spark, str(tmp_path / "mail_fti.dat"), "none").count()


def test_stream_is_idempotent(spark, tmp_path):
    from lectern.streaming.incremental import ingest_stream

    def run(**kw):
        source = spark.readStream.schema("id long, date string").parquet(str(tmp_path / "in"))
        ingest_stream(source, str(tmp_path / "sink"), str(tmp_path / "check"), ["id"], **kw).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "sink")).collect())

    put = lambda rows: spark.createDataFrame(rows, "id long, date string").write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "2024-01-02"), (1, "2024-01-02"), (2, "2024-01-03")])
    assert run() == [1, 2] == run()
    put([(2, "2024-01-05"), (3, "2024-01-01"), (4, "2024-01-04")])
    assert run(date_col="date", allow_late=False) == [1, 2, 4]  # the late row is lost, as asked


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "hybrid_search" in entry.queries()
