"""Trees, single files, bytes and selection."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lintlake import findings, from_table, read_file, read_tree, scan, scan_files, schema
from lintlake.functions import paths, text
from lintlake.operators import manifest, metrics
from lintlake.sources import store, tree
from lintlake.sources.store import remove_folder
from lintlake.sources.tables import scannable, skip_reason, spread
from lintlake.sources.tree import list_tree


def write(root, files):
    for path, content in files.items():
        place = root / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content if isinstance(content, bytes) else content.encode())


def paths_of(frame):
    return sorted(row["path"] for row in frame.select("path").collect())


def test_tree(spark, tmp_path):
    write(tmp_path, {
        "main.py": "x", "app.js": "x", "README.md": "x", "src/lib.py": "x",
        "node_modules/pkg/index.js": "x", ".git/config": "x", ".git/hook.py": "x",
        "pkg/__init__.py": "x", ".hidden.py": "x", "_private/_x.py": "x", "src/build/y.py": "x",
        "src/builder/z.py": "x", "a/b/c/d/e/f.go": "x", "x.egg-info/k.py": "x",
        "src/.cache/k.py": "x", "Dockerfile.dev": "x", "sub/Makefile": "x",
    })
    (tmp_path / "empty").mkdir()
    assert paths_of(read_tree(spark, str(tmp_path))) == sorted([
        "main.py", "app.js", "src/lib.py", "pkg/__init__.py", ".hidden.py", "_private/_x.py",
        "src/builder/z.py", "a/b/c/d/e/f.go", "x.egg-info/k.py", "Dockerfile.dev", "sub/Makefile",
    ])


def test_root_itself_is_not_tested(spark, tmp_path):
    write(tmp_path, {"build/.x/src/a.py": "x", "build/.x/src/build/b.py": "x"})
    assert paths_of(read_tree(spark, str(tmp_path / "build" / ".x"))) == ["src/a.py"]
    assert paths_of(read_tree(spark, str(tmp_path / "build" / ".x") + "/")) == ["src/a.py"]


def test_a_uri_as_root(spark, tmp_path):
    write(tmp_path, {"a/_b.py": "# TODO x", "node_modules/c.py": "x", "d.js": ""})
    files = read_tree(spark, tmp_path.as_uri())
    assert paths_of(files) == ["a/_b.py", "d.js"]
    assert [f["rule_id"] for f in scan(files).collect()] == ["QUA001"]


def test_sizes(spark, tmp_path):
    write(tmp_path, {
        "fits.py": b"a" * 1_000_000, "large.py": b"a" * 1_000_001, "empty.py": b"",
    })
    files = {f["path"]: f["size"] for f in read_tree(spark, str(tmp_path)).collect()}
    assert files == {"fits.py": 1_000_000, "empty.py": 0}
    # A file named itself is read whatever its size.
    assert read_file(spark, str(tmp_path / "large.py")).first()["size"] == 1_000_001


def test_links(spark, tmp_path):
    write(tmp_path, {"tree/a.py": "x", "outside/b.py": "xyz"})
    os.symlink(tmp_path / "outside", tmp_path / "tree" / "dir")
    os.symlink(tmp_path / "tree", tmp_path / "tree" / "loop")
    os.symlink(tmp_path / "outside" / "b.py", tmp_path / "tree" / "link.py")
    os.symlink(tmp_path / "nowhere.py", tmp_path / "tree" / "broken.py")
    files = {f["path"]: f["size"] for f in read_tree(spark, str(tmp_path / "tree")).collect()}
    assert files == {"a.py": 1, "link.py": 3}


def test_empty_tree(spark, tmp_path):
    scanned = scan_files(read_tree(spark, str(tmp_path)))
    row = metrics.summary(metrics.tally(scanned)).first()
    assert (row["files_scanned"], row["total_findings"], row["score"], row["grade"]) == (0, 0, 100, "A+")


def test_single_file(spark, tmp_path):
    write(tmp_path, {
        "build/target.py": 'password = "supersecret"\n', "build/other.py": 'password = "othersecret"',
        "build/notes.txt": "x",
    })
    for reader in (read_file, read_tree):
        files = reader(spark, str(tmp_path / "build" / "target.py"))
        rows = scan(files).collect()
        assert [(r["rule_id"], r["file_path"], r["line_number"]) for r in rows] == [("SEC001", ".", 1)]
    assert read_file(spark, str(tmp_path / "build" / "notes.txt")).count() == 0


def test_a_file_that_vanishes_still_counts(spark, tmp_path):
    write(tmp_path, {"a.py": "eval(x)\n", "b.py": "eval(x)"})
    files = read_tree(spark, str(tmp_path))
    (tmp_path / "b.py").unlink()
    scanned = {row["path"]: row for row in scan_files(files).collect()}
    assert scanned["a.py"]["lines"] == 2 and len(scanned["a.py"]["hits"]) == 1
    assert scanned["b.py"]["lines"] == 0 and scanned["b.py"]["hits"] == []


def test_decode_like_python(spark):
    rng = random.Random(5)
    pieces = [b"a", b"\r", b"\n", b"\r\n", "é€\U0001f600".encode(), b"\xff", b"\xc3", b"\xe2\x82",
              b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xf4\x90\x80\x80", b"\xc0\xaf", b"\x00", b"\xef\xbb\xbf",
              b"\xe0\x80\x80", b"\xf8\x88\x80\x80\x80"]
    rows = [
        (i, b"".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(3000)
    ]
    table = spark.createDataFrame(rows, "id int, content binary")
    got = dict(table.select("id", text.decode_text(F.col("content"))).collect())
    for i, content in rows:
        expected = content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        assert got[i] == expected, content


LANGUAGES = {
    "a.py": "python", "b.PYW": "python", "c.jsx": "javascript", "d.tsx": "typescript", "e.go": "go",
    "f.rs": "rust", "G.java": "java", "h.rb": "ruby", "i.php": "php", "j.h": "c", "k.hpp": "cpp",
    "l.cs": "csharp", "m.zsh": "shell", "n.yaml": "yaml", "Dockerfile": "dockerfile",
    "Dockerfile.py": "dockerfile", "dockerfile": None, "o.Dockerfile": None, "p.tf": "terraform",
    "q.sql": "sql", "Makefile": "shell", "GNUmakefile": "shell", "makefile": "shell",
    "MAKEFILE": None, "x/y.z/a.py": "python", "x.py/a": None, ".py": None, "..py": None,
    ".a.py": "python", "a.": None, "a.txt": None, "a.tar.sh": "shell", "": None, "a.py ": None,
}


def test_languages(spark):
    table = spark.createDataFrame([(p,) for p in LANGUAGES], "path string")
    assert dict(table.select("path", paths.detect_language(F.col("path"))).collect()) == LANGUAGES


def test_suffix_like_python(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("a.bP\n") for _ in range(rng.randrange(8))) for _ in range(2000)]
    table = spark.createDataFrame([(n,) for n in names], "path string")
    for name, got in table.select("path", paths.suffix(F.col("path"))).collect():
        assert got == os.path.splitext(name)[1], repr(name)


def test_strip_like_python(spark):
    rng = random.Random(7)
    chars = ["a", " ", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "​", "　",
             " ", "⁠", "\x00", "é"]
    values = ["".join(rng.choice(chars) for _ in range(rng.randrange(9))) for _ in range(2000)]
    values.append(" " + "é" * 100)
    table = spark.createDataFrame([(v,) for v in values], "v string")
    for value, stripped, cut in table.select(
        "v", text.strip(F.col("v")), text.snippet(F.col("v"))
    ).collect():
        assert stripped == value.strip() and cut == value.strip()[:80]


def test_selection(spark):
    rows = [
        ("a.py", "python", 1, None), ("build/a.py", "python", 1, "directory"), ("build", "python", 1, None),
        ("a/.x/b.py", "python", 1, "directory"), ("a/.b.py", "python", 1, None), ("a.txt", None, 1, "language"),
        ("b.py", "python", None, "unreadable"), ("c.py", "python", 1_000_000, None),
        ("d.py", "python", 1_000_001, "size"),
    ]
    table = spark.createDataFrame(
        [(p, lang, size, "") for p, lang, size, _ in rows], schema.FILES
    )
    reasons = dict(table.select("path", skip_reason()).collect())
    assert reasons == {p: reason for p, _, _, reason in rows}
    assert paths_of(scannable(table)) == sorted(p for p, _, _, reason in rows if reason is None)
    counts = dict(metrics.skip_counts(table, skip_reason()).collect())
    assert counts == {"directory": 2, "language": 1, "unreadable": 1, "size": 1}


@pytest.mark.parametrize(
    ("path", "root", "expected"),
    [("/a/b/c.py", "/a/b", "c.py"), ("/a/b/c.py", "/a/b/", "c.py"), ("/a/b", "/a/b", "."),
     ("/ab/c", "/a", "/ab/c"), ("/a", "/", "a")],
)
def test_relative_path(spark, path, root, expected):
    frame = spark.createDataFrame([(path,)], "path string")
    assert frame.select(paths.rel_path(F.col("path"), root)).first()[0] == expected


def test_manifest(spark, tmp_path):
    import hashlib

    write(tmp_path, {"b/x.bin": b"\x00\xff", "a.py": "x", ".git/config": "x", "c/__pycache__/y.pyc": "x",
                     ".github/w.yml": "y", "build/out": ""})
    got = [tuple(row) for row in manifest.tree_manifest(spark, str(tmp_path)).collect()]
    expected = {
        ".github/w.yml": b"y", "a.py": b"x", "b/x.bin": b"\x00\xff", "build/out": b"",
    }
    assert got == [(p, hashlib.sha256(c).hexdigest()) for p, c in sorted(expected.items())]


def test_what_cannot_be_listed(spark, tmp_path, monkeypatch):
    write(tmp_path, {"a.py": "x", "shut/b.py": "y"})
    for missing in ("nope", "nope/deeper"):
        for listing in (list_tree, manifest.tree_manifest, read_tree):
            with pytest.raises(Exception, match="(?i)no such file|not found|does not exist"):
                listing(spark, str(tmp_path / missing)).collect()
    real = tree.os.scandir

    def scandir(path):
        if str(path).endswith("shut"):
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(tree.os, "scandir", scandir)
    assert sorted(tree._entries(str(tmp_path), "shut", False)) == [("shut/", False, None)]
    with pytest.raises(PermissionError):
        list(tree._entries(str(tmp_path), "shut", True))
    table = spark.createDataFrame([("shut/", None, None, None)], schema.FILES)
    assert table.select(skip_reason()).first()[0] == "unreadable"


def test_single_file_by_uri(spark, tmp_path):
    write(tmp_path, {"a.py": 'password = "supersecret"\n'})
    rows = scan(read_tree(spark, f"file://{tmp_path}/a.py")).collect()
    assert [(r["rule_id"], r["file_path"]) for r in rows] == [("SEC001", ".")]


def test_listing_many_entries(spark, tmp_path):
    write(tmp_path, {f"d{i % 7}/f{i}.py": "" for i in range(700)})
    assert list_tree(spark, str(tmp_path)).count() == 700


def test_stored_in_the_shared_folder(spark):
    folder = store.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in folder
    kept = store.keep(spark.range(5))
    assert kept.count() == 5 and all(f.startswith("file:") for f in kept.inputFiles())
    store.release(kept.where("id > 1"))
    with pytest.raises(Exception, match="not exist"):
        kept.count()


def test_no_machine_local_folder_without_a_setting(spark):
    class Session:
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})
        conf = {"spark.sql.warehouse.dir": "hdfs://x/wh/"}

    assert store.shared_dir(Session) == "hdfs://x/wh/intermediate"


def test_findings_of_the_fixtures(spark, tmp_path):
    write(tmp_path, {
        "clean.py": "def add(a, b):\n    return a + b\n\ndef sub(a, b):\n    return a - b\n",
        "mixed.py": "# TODO: x\npassword = \"longsecret\"\nDEBUG = True\n",
    })
    scanned = scan_files(read_tree(spark, str(tmp_path)))
    assert findings(scanned).where("file_path = 'clean.py'").count() == 0
    high = scan(read_tree(spark, str(tmp_path)), min_severity="high")
    assert {row["severity"] for row in high.collect()} == {"critical"}


def test_texts_of_many_files_are_not_shuffled(spark, tmp_path):
    """A table in as many files as cores is scanned where it lies; a smaller one is dealt out."""
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    made = spark.range(64).selectExpr("cast(id AS string) AS path", "'eval(x)' AS text")
    made.repartition(64).write.option("maxRecordsPerFile", 1).parquet(many)
    made.coalesce(1).write.parquet(one)
    packed = spark.conf.get("spark.sql.files.openCostInBytes")
    for place, dealt in ((many, False), (one, True)):
        files = from_table(spread(spark.read.parquet(place)), "path", "text", "python")
        plan = scan(files)._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange RoundRobin" in plan) == dealt, packed
        assert scan(files).count() == 64


def test_remove_folder(spark, tmp_path):
    place = tmp_path / "some" / "where"
    place.mkdir(parents=True)
    (place / "file").write_text("x")
    remove_folder(spark, str(tmp_path / "some"))
    assert not (tmp_path / "some").exists()
