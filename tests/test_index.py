import json
import os

import pytest

from quern.operators.edits import bulk_edit
from quern.operators.index import Index, tables_from
from quern.operators.workspace import READ_TOOLS, WRITE_TOOLS, Workspace, write_whole
from quern.schemas import TABLES
from quern.sources.tree import sources
from quern.streaming.indexing import index_stream


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, text string")


def content(index):
    return {t: sorted(map(tuple, df.collect()), key=str) for t, df in index.tables().items()}


def test_refresh_keeps_replaces_and_survives_errors(spark, tmp_path, sample):
    index = Index(spark, str(tmp_path / "i"), 4)
    first = {r["file_path"]: r for r in index.refresh(frame(spark, ("/a.py", sample), ("/b.py", "x = 1\n"), ("/c.py", "def c(): pass\n"))).collect()}
    assert all(r["changed"] and r["error"] is None for r in first.values())
    before = content(index)
    assert [r["changed"] for r in index.refresh(frame(spark, ("/a.py", sample))).collect()] == [False]
    assert content(index) == before
    got = {r["file_path"]: r for r in index.refresh(frame(spark, ("/a.py", "def (:\n"), ("/c.py", "y = 2\n"))).collect()}
    assert not got["/a.py"]["changed"] and got["/a.py"]["error"]["type"] == "SyntaxError" and got["/c.py"]["changed"]
    functions = {r["file_path"] for r in index.tables()["functions"].collect()}
    assert functions == {"/a.py"}  # the broken file keeps its rows, the other one lost its function
    # An incremental index equals one built at once.
    whole = Index(spark, str(tmp_path / "w"), 4)
    whole.refresh(frame(spark, ("/a.py", sample), ("/b.py", "x = 1\n"), ("/c.py", "y = 2\n")))
    assert content(whole) == content(index)
    assert index.content_hash("/b.py") and index.content_hash("/none.py") is None


def test_other_layouts_are_dropped(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), 2)
    index.refresh(frame(spark, ("/a.py", "x = 1\n")))
    path = tmp_path / "i" / "manifest.json"
    assert Index(spark, str(tmp_path / "i")).tables()["files"].count() == 1
    path.write_text(json.dumps(json.loads(path.read_text()) | {"schema_version": 1}))
    (tmp_path / "i" / ".manifest.json.crc").unlink(missing_ok=True)
    assert Index(spark, str(tmp_path / "i")).tables()["files"].count() == 0


def folders(path, prefix):
    return sorted(x for x in os.listdir(path) if x.startswith(prefix))


def test_refreshes_leave_no_folders(spark, tmp_path):
    root = tmp_path / "i"
    index = Index(spark, str(root), 2)
    for i in range(4):
        index.refresh(frame(spark, ("/a.py", f"x = {i}\n"), ("/b.py", "def b(): pass\n")))
        index.refresh(frame(spark, ("/a.py", f"x = {i}\n")))
    assert not folders(root, "staged-") and len(folders(root, "part-")) <= 3
    before = content(index)
    (root / "staged-lost").mkdir()
    (root / "part-lost" / "files" / "bucket=0").mkdir(parents=True)
    index.vacuum()
    assert content(index) == before and not folders(root, "staged-") and "part-lost" not in folders(root, "part-")


def test_a_reader_of_the_tables_before_can_finish(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), 2)
    index.refresh(frame(spark, ("/a.py", "def a(): pass\n")))
    held = index.tables()["functions"]
    index.refresh(frame(spark, ("/a.py", "def b(): pass\n")))
    assert [r["name"] for r in held.collect()] == ["a"] and [r["name"] for r in index.tables()["functions"].collect()] == ["b"]


def test_one_file_opens_one_bucket(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "i"), 16)
    index.refresh(frame(spark, *[(f"/{i}.py", f"x = {i}\n") for i in range(60)]))
    opened = []
    kept = Index._bucketed
    monkeypatch.setattr(Index, "_bucketed", lambda self, m, t, b: opened.append((t, tuple(b))) or kept(self, m, t, b))
    index.refresh(frame(spark, ("/7.py", "x = 8\n")))
    assert len({b for _, b in opened}) == 1 and all(len(b) == 1 for _, b in opened)
    assert index.tables()["files"].count() == 60


def test_one_path_several_times(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), 2)
    same = "def a(): pass\n"
    got = index.refresh(frame(spark, ("/a.py", same), ("/a.py", same), ("/b.py", "x = 1\n"), ("/b.py", "x = 2\n"))).collect()
    rows = {r["file_path"]: r for r in got}
    assert len(got) == 2 and rows["/a.py"]["changed"] and rows["/a.py"]["error"] is None
    assert not rows["/b.py"]["changed"] and rows["/b.py"]["error"]["msg"] == "several texts for one path"
    assert [r["file_path"] for r in index.tables()["files"].collect()] == ["/a.py"] and index.tables()["functions"].count() == 1


def test_another_python_leaves_an_index_alone(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    own = Index(spark, root, 2)
    own.refresh(frame(spark, ("/a.py", "x = 1\n")))
    monkeypatch.setattr(Index, "_python", staticmethod(lambda: "9.9"))
    other = Index(spark, root, 2)
    assert other.tables()["files"].count() == 0
    other.refresh(frame(spark, ("/b.py", "x = 1\n")))
    assert [r[0] for r in Index(spark, root).tables()["files"].select("file_path").collect()] == ["/b.py"]
    monkeypatch.undo()
    assert [r[0] for r in Index(spark, root).tables()["files"].select("file_path").collect()] == ["/a.py"]


def test_bulk_edits_reach_the_disk_and_the_index(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"m{i}.py").write_text(f"def f{i}():\n    return {i}\n")
    w = Workspace(spark, str(tmp_path / "i"), approve=lambda path, text: not path.endswith("m3.py"))
    rows = [(str(tmp_path / f"m{i}.py"), "add_function", json.dumps({"new_code": f"def g{i}(): pass"})) for i in range(4)]
    rows += [(str(tmp_path / "m4.py"), "delete_definition", '{"name": "none"}'), (str(tmp_path / "none.py"), "add_imports", '{"imports": "import a"}')]
    got = {os.path.basename(r["file_path"]): r for r in w.bulk_edit(spark.createDataFrame(rows, "file_path string, operation string, arguments string")).collect()}
    assert [got[f"m{i}.py"]["status"] for i in range(5)] == ["changed"] * 3 + ["refused"] * 2 and got["none.py"]["status"] == "refused"
    assert "not approved" in got["m3.py"]["message"] and "def g2" in (tmp_path / "m2.py").read_text() and "def g3" not in (tmp_path / "m3.py").read_text()
    assert sorted(r["name"] for r in w.index.tables()["functions"].collect()) == ["f0", "f1", "f2", "g0", "g1", "g2"]


def test_tables_have_their_columns(spark):
    for name, df in tables_from(frame(spark, ("/a.py", "x = 1"))).items():
        assert df.columns == [c.split(" ")[0] for c in TABLES[name].split(", ")]


def test_source_reads_what_file_sources_leave_out(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name, data in (("__init__.py", b""), (".hidden.py", b"x = 1\r\n"), ("bad.PY", b"\xff"), ("note.txt", b"")):
        (tmp_path / "p" / name).write_bytes(data)
    os.symlink(tmp_path / "p" / ".hidden.py", tmp_path / "link.py")
    got = {os.path.basename(r["file_path"]): r for r in sources(spark, str(tmp_path)).collect()}
    assert set(got) == {"__init__.py", ".hidden.py", "bad.PY"}
    assert got[".hidden.py"]["text"] == "x = 1\n" and got[".hidden.py"]["raw"] == "x = 1\r\n"
    assert got["bad.PY"]["text"] is None and got["bad.PY"]["error"] == "not valid UTF-8"
    one = sources(spark, str(tmp_path)).where(f"file_path = '{tmp_path.resolve()}/p/__init__.py'")
    assert [r["text"] for r in one.collect()] == [""]


def test_bulk_edits(spark):
    src = frame(spark, ("/a.py", "x = 1\n"), ("/b.py", "def f(): pass\n"))
    rows = [("/a.py", "replace_text", '{"old_text": "1", "new_text": "2"}'), ("/b.py", "delete_definition", '{"name": "f"}'), ("/b.py", "add_imports", '{"imports": "import a"}'), ("/c.py", "add_imports", '{"imports": "import a"}')]
    got = {(r["file_path"], r["operation"]): r for r in bulk_edit(src, spark.createDataFrame(rows, "file_path string, operation string, arguments string")).collect()}
    assert got["/a.py", "replace_text"]["new_text"] == "x = 2\n"
    assert {r["status"] for k, r in got.items() if k[0] != "/a.py"} == {"refused"}


def test_workspace(spark, tmp_path, sample):
    file = tmp_path / "m.py"
    file.write_text(sample)
    os.chmod(file, 0o640)
    w = Workspace(spark, str(tmp_path / "i"))
    assert w.expand_class(str(file), "Tiny").endswith("class Tiny:\n    pass\n```")
    assert w.replace_function(str(file), "weigh", "def weigh():\n    return 2") == "Replaced function `weigh` (was lines 15-16, now lines 15-16) in `m.py`. The file was re-indexed."
    assert "return 2" in w.expand_function(str(file), "weigh")
    assert file.stat().st_mode & 0o777 == 0o640
    assert not w.save_file(str(file))
    text = file.read_text()
    assert "Nothing was written" in w.delete_definition(str(file), "none") and file.read_text() == text
    file.write_text("def (:\n")
    assert w.get_file_functions(str(file)).startswith(f"**Error:** `{file}` cannot be parsed (line 1)")
    file.write_bytes(b"\xff")
    assert "could not be read" in w.get_file_imports(str(file))
    assert w.get_file_imports(str(tmp_path / "none.py")).endswith("is not an existing Python (.py) file.")
    assert all(callable(getattr(w, t)) for t in (*READ_TOOLS, *WRITE_TOOLS)) and len(READ_TOOLS) == 8 and len(WRITE_TOOLS) == 9


def test_a_failed_write_leaves_nothing(tmp_path, monkeypatch):
    file = tmp_path / "m.py"
    file.write_text("x = 1\n")
    monkeypatch.setattr(os, "replace", lambda *_: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        write_whole(file, "x = 2\n")
    assert file.read_text() == "x = 1\n" and os.listdir(tmp_path) == ["m.py"]


def test_stream(spark, tmp_path):
    frame(spark, ("/a.py", "def a(): pass\n")).write.parquet(str(tmp_path / "in"))
    index = Index(spark, str(tmp_path / "i"), 2)
    query = index_stream(spark.readStream.schema("file_path string, text string").parquet(str(tmp_path / "in")), index, str(tmp_path / "c"), availableNow=True)
    query.awaitTermination()
    assert [r["name"] for r in index.tables()["functions"].collect()] == ["a"]
