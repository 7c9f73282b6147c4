"""Directory corpora: walking, building, updating, searching and the command line."""

import json
import os
import subprocess
import sys

import pytest

from gramlode import cli
from gramlode.operators import freshness, index as ix, render, search as se
from gramlode.sources import corpus as co


def put(root, files):
    for name, content in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)) or root, exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_walk(tmp_path):
    put(tmp_path, {"a.py": "x", "__init__.py": "x", "_x.c": "x", ".hid": "x", "node_modules/n.js": "x", "sub/venv/v.py": "x", "target/t.rs": "x", "drivers/target/t.rs": "x", "p.egg-info/x": "x", ".gramlodeignore": "*.log\n/only.txt\ngen/\n!keep.log\n", "b.log": "x", "keep.log": "x", "only.txt": "x", "sub/only.txt": "x", "gen/g.c": "x", "sub/.gramlodeignore": "deep/**\n", "sub/deep/z.c": "x"})
    assert [p for p, *_ in co.walk(str(tmp_path))] == ["__init__.py", "_x.c", "a.py", "drivers/target/t.rs", "keep.log", "sub/only.txt"]


def test_git_ignores(tmp_path):
    put(tmp_path, {".git/info/exclude": "excluded\n", ".gitignore": "*.o\n", "a.o": "x", "a.c": "x", "excluded": "x"})
    assert [p for p, *_ in co.walk(str(tmp_path))] == ["a.c"]


def test_build_counts(spark, tmp_path):
    put(tmp_path, {"hello.txt": "hello", "same.txt": "hello", "bin.dat": b"ab\0cd", "big.txt": "y" * 200, "limit.txt": "z" * 100, "tiny": "ab", "empty": ""})
    index = ix.build(co.directory_corpus(spark, str(tmp_path), 100), str(tmp_path / "i"), 100)
    m = index.meta
    assert (m["file_count"], m["skipped_binary"], m["skipped_large"], m["ngram_count"], m["total_ngrams"]) == (5, 1, 1, 4, 7)
    assert index.lookup(0x68656C).count() == 2
    again = ix.open_index(spark, str(tmp_path / "i"))
    assert again.meta == m and ix.clean(spark, str(tmp_path / "i")) and not ix.clean(spark, str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        ix.open_index(spark, str(tmp_path / "i"))


def test_incremental_equals_full(spark, tmp_path):
    root, where = str(tmp_path / "r"), str(tmp_path / "i")
    put(root, {"a.txt": "alpha beta", "b.txt": "gamma", "c.txt": "delta"})
    index = ix.build(co.directory_corpus(spark, root), where)
    assert freshness.refresh(index, co.directory_corpus(spark, root))[1] == "fresh"
    put(root, {"a.txt": "alphb beta", "d.txt": "new one"})
    os.utime(f"{root}/a.txt", ns=(1, 1))
    os.remove(f"{root}/b.txt")
    changes = freshness.diff(index.states, co.listing(spark, root))
    assert sorted(rows(changes, "path", "change")) == [("a.txt", "changed"), ("b.txt", "deleted"), ("d.txt", "added")]
    new, mode = freshness.refresh(index, co.directory_corpus(spark, root))
    assert mode == "incremental: 1 changed, 1 new, 1 deleted"
    full = ix.build(co.directory_corpus(spark, root), str(tmp_path / "f"))
    assert sorted(rows(new.postings, "gram", "file_id")) == sorted(rows(full.postings, "gram", "file_id"))
    assert (new.file_count, new.gram_count) == (full.file_count, full.gram_count)
    assert freshness.refresh(new, co.directory_corpus(spark, root), 5)[1] == "full rebuild"


def test_search_semantics(spark, tmp_path):
    put(tmp_path, {"a.txt": "l1\nl2\nMATCH\nl4\nMATCH\n", "crlf.txt": "x\r\r\nfoo\r\n", "bad.txt": b"ok\n\xff foo\nfoo\n", "É.txt": "École k\u212a", "u.txt": "foo\u2028bar", "empty.txt": "", "sub/b.rs": "fn main() { hello(); }"})
    corpus = co.directory_corpus(spark, str(tmp_path))
    index = ix.build(corpus, str(tmp_path / "i"))
    find = lambda p, **f: rows(se.search(index, corpus, p, scan_share=1.0, **f), "path", "line_number")
    assert find("foo$") == [("bad.txt", 3), ("crlf.txt", 2)]
    assert find("^x\r$") == [("crlf.txt", 1)]
    assert find("foo.bar") == [("u.txt", 1)]
    assert find("ÉCOLE", ignore_case=True) == [("É.txt", 1)] and find("ÉCOLE") == []
    assert find("kk", ignore_case=True) == [("É.txt", 1)]
    assert find("hello", path_filter=r"\.rs$") == [("sub/b.rs", 1)] and find("hello", path_filter=r"\.RS$") == []
    assert find("a\\nb") == []
    m = se.search(index, corpus, "MATCH", before=2, after=1, limit=1).first()
    assert (m.line_number, m.context_before, m.context_after) == (3, ["l1", "l2"], ["l4"])
    only = se.search(index, corpus, "MATCH", files_only=True, before=2).collect()
    assert [(r.path, r.line_number, r.line_text, r.context_before) for r in only] == [("a.txt", 0, "", [])]
    text = render.text(se.search(index, corpus, "MATCH", before=1, after=1, limit=1)).first().text
    assert text == "a.txt-2-l2\na.txt:3:MATCH\na.txt-4-l4"
    painted = render.text(se.search(index, corpus, "MATCH", limit=1), pattern="MA").first().text
    assert painted == "\x1b[1;35ma.txt\x1b[0m\x1b[36m:\x1b[0m\x1b[32m3\x1b[0m\x1b[36m:\x1b[0m\x1b[1;31mMA\x1b[0mTCH"
    for p, flags in (("o", {}), ("[a-z]{3}", {}), ("É", {"ignore_case": True}), ("foo|MATCH", {})):
        assert find(p, **flags) == rows(se.scan(corpus, p, **flags), "path", "line_number")


def test_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "FOLDER_BYTES", 40)
    put(tmp_path, {f"{i}.txt": f"{'abc xyz é' * i}" for i in range(30)})
    corpus = co.directory_corpus(spark, str(tmp_path))
    index = ix.build(corpus, str(tmp_path / "i"))
    assert index.meta["folder_shift"] == 17 and index.rows_of([0x616263, 0xC3A961]).count() == 29 + 28
    assert sorted(rows(index.postings, "gram", "file_id")) == sorted(rows(ix.postings_of(corpus), "gram", "file_id"))


def test_dense_ids(spark):
    names = ["zebra.py", "alpha.py", "middle.py", "sub/beta.py", "é", "Z"]
    df = spark.createDataFrame([(n,) for n in names], "path string").repartition(3)
    assert dict(rows(ix.dense_ids(df), "path", "dense_id")) == {n: i for i, n in enumerate(sorted(names, key=str.encode))}
    assert ix.dense_ids(df.filter("false")).count() == 0


def test_stream(spark, tmp_path):
    from gramlode.streaming.ingest import index_stream

    corpus = co.table_corpus(spark.createDataFrame([(1, "a", "hello"), (2, "b", "world")], "k long, p string, t string"), *[__import__("pyspark").sql.functions.col(c) for c in "kpt"])
    corpus.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    corpus.filter("file_id = 1").selectExpr("3L file_id", "'c' path", "size", "mtime_ns", "text", "bad").write.mode("append").parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    assert sorted(rows(ix.open_index(spark, str(tmp_path / "i")).lookup(0x68656C), "file_id")) == [(1,), (3,)]


@pytest.fixture
def here(tmp_path, monkeypatch, spark):
    put(tmp_path, {"a.txt": "hello", "b.txt": "say \"hello\" and\\tab\nhello hello", "c.txt": "nothing"})
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda: spark)


def test_cli(here, capsys):
    assert cli.main(["status", "--json"]) == 0 and json.loads(capsys.readouterr().out)["freshness"] == "none"
    assert cli.main(["search", "hello", "--no-index", "--json"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert not os.path.exists(".gramlode") and out[-1]["mode"] == "no-index" and out[-1]["match_count"] == 3
    assert cli.main(["search", "hello", "--json"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [m["line_text"] for m in out[:-1]] == ["hello", 'say "hello" and\\tab', "hello hello"] and (out[-1]["match_count"], out[-1]["file_count"]) == (3, 2)
    assert cli.main(["status", "--json"]) == 0 and json.loads(capsys.readouterr().out)["freshness"] == "fresh"
    put(".", {"d.txt": "one more hello"})
    assert cli.main(["search", "one more", "-m", "1"]) == 0 and capsys.readouterr().out == "d.txt:1:one more hello\n"
    assert cli.main(["search", "zzz"]) == 1 and cli.main(["search", "("]) == 1
    assert cli.main(["search", "hello", "--explain"]) == 0 and "AND(" in capsys.readouterr().out
    assert cli.main(["index", "--json"]) == 0 and json.loads(capsys.readouterr().out)["mode"] == "fresh"
    assert cli.main(["index", "--force"]) == 0 and "[full rebuild]" in capsys.readouterr().out
    assert cli.main(["clean"]) == 0 and not os.path.exists(".gramlode")


def test_nothing_imports_llm():
    code = "import sys, gramlode.cli, gramlode.registry; print([m for m in sys.modules if m.startswith('gramlode.llm')])"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "[]"


def test_ignore_files_above_the_root(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", "/dev/null")
    for path, text in {"config/git/ignore": "*.bak\n", "top/.git/info/exclude": "secret.txt\n", "top/.gitignore": "*.o\n/sub/made/\n", "top/sub/.gitignore": "!keep.o\n", "top/sub/a.o": "", "top/sub/keep.o": "", "top/sub/x.bak": "", "top/sub/secret.txt": "", "top/sub/made/f.txt": "", "top/sub/deep/f.txt": "", f"top/{co.IGNORE_FILE}": "deep/no.txt\nno2.txt\n", "top/sub/deep/no2.txt": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [p for p, _, _ in co.walk(str(tmp_path / "top/sub"))] == ["deep/f.txt", "keep.o"]


def test_only_candidates_are_opened(spark, tmp_path):
    """Contents are read for files that changed, and for candidates; the others' are gone in between, which nobody notices."""
    for i in range(40):
        (tmp_path / f"f{i}.txt").write_text(f"common words {i}")
    (tmp_path / "one.txt").write_text("PyObject_GC_Track here")
    corpus = co.directory_corpus(spark, str(tmp_path))
    corpus.states()
    index = ix.build(corpus, str(tmp_path / ".index"))
    opened = lambda df: sorted(r.path for r in df.select("path").collect())
    choice = se.chosen(index, "GC_Track")
    assert (choice.mode, choice.candidates) == ("indexed", 1) and opened(co.texts(corpus, choice.files)) == ["one.txt"]
    times = {p.name: p.stat() for p in tmp_path.glob("f*.txt")}
    for p in tmp_path.glob("f*.txt"):  # other contents of the same size and time: a search that opened them would find them
        p.write_text("GC_Track" + "x" * (times[p.name].st_size - 8))
        os.utime(p, ns=(times[p.name].st_atime_ns, times[p.name].st_mtime_ns))
    assert opened(se.search(index, corpus, "GC_Track")) == ["one.txt"]
    assert len(opened(se.scan(corpus, "GC_Track"))) == 41
    assert freshness.refresh(index, corpus)[1] == "fresh"
    (tmp_path / "f7.txt").write_text("changed words")
    new, mode = freshness.refresh(index, co.directory_corpus(spark, str(tmp_path)))
    assert mode == "incremental: 1 changed, 0 new, 0 deleted"
    assert new.lookup(int.from_bytes(b"gc_", "big")).count() == 1  # the files that did not change were not read again
