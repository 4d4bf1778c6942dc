"""Code-tree data source keeps hidden/underscore names and prunes folders; index round trip."""
import os

from pyspark.sql import functions as F

from codeweave.operators import completion as C
from codeweave.operators import generation as GEN
from codeweave.plans import index_build as IB
from codeweave.sources import code_tree, index_io


def make_tree(root):
    files = {
        "pkg/__init__.py": "import os\n",
        "pkg/_x.py": "from pkg import y\n",
        ".github/w.py": "print(1)\r\n",
        "build/skip.py": "x = 1\n",
        "top.py": "import sys\n",
        "pkg/setup.cfg": "[x]\n",
        "big.py": "x" * 300,
    }
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    with open(os.path.join(root, "pkg", "bad.py"), "wb") as f:
        f.write(b"\xff\xfe")


def test_code_tree_scan(spark, tmp_dir):
    make_tree(tmp_dir)
    files = code_tree.read_code_tree(spark, tmp_dir, "repo", ["python"], max_bytes=200)
    got = {r.file_path: r.size_bytes for r in files.collect()}
    assert {"pkg/__init__.py", "pkg/_x.py", ".github/w.py", "top.py", "pkg/setup.cfg", "big.py"} <= set(got)
    assert "build/skip.py" not in got                   # pruned for every requested language
    sel = {r.file_path: (r.language, r.is_config, r.code)
           for r in GEN.select_passes(files, ["python"], max_bytes=200).collect()}
    assert sel[".github/w.py"][2] == "print(1)\n"
    assert sel["pkg/setup.cfg"][1] is True
    assert "big.py" not in sel and "pkg/bad.py" not in sel


def test_end_to_end_index(spark, tmp_dir):
    make_tree(tmp_dir)
    files = code_tree.read_code_tree(spark, tmp_dir, "repo", ["python"])
    prep = IB.prepare_corpus(files, ["python"], C.echo_metadata_stub, "stub",
                             cache_path=os.path.join(tmp_dir, "_cache"))
    ann = prep["annotated"]
    rows = {r.target_path: r.text for r in ann.collect()}
    assert "pkg/__init__.txt" in rows and rows["pkg/__init__.txt"].startswith('"""This file is located at')
    # second run: every prompt is served from the cache (no new rows appended)
    n_cache = spark.read.parquet(os.path.join(tmp_dir, "_cache")).count()
    IB.prepare_corpus(files, ["python"], C.echo_metadata_stub, "stub",
                      cache_path=os.path.join(tmp_dir, "_cache"))["annotated"].count()
    assert spark.read.parquet(os.path.join(tmp_dir, "_cache")).count() == n_cache
    corpus = index_io.corpus_documents(ann)
    tables = IB.build_index(corpus, IB.metadata_rows(ann), chunk_size=50, chunk_overlap=5)
    root = os.path.join(tmp_dir, "index")
    index_io.write_index(tables, root)
    idx = IB.Index(spark, root)
    assert set(index_io.INDEX_TABLES) < set(idx.raw_data()) <= {*index_io.INDEX_TABLES, *index_io.MORE_TABLES}
    assert idx.tables["text_units"].count() >= len(rows)
    idx.dependency_layers().collect()
    index_io.export_index(spark, root, os.path.join(tmp_dir, "copy"))
    assert IB.Index(spark, os.path.join(tmp_dir, "copy")).tables["entities"].count() == \
        idx.tables["entities"].count()
    assert idx.global_search("what purpose").columns[:2] == ["community", "level"]
    ctx = idx.local_search("pkg init module", k=3).collect()
    assert ctx and ctx[0].kind == "entity" and all(r.used_tokens <= 8000 for r in ctx)


def test_code_tree_links_and_depth(spark, tmp_dir):
    make_tree(tmp_dir)
    deep = os.path.join(tmp_dir, "a/b/c/d/e")
    os.makedirs(deep)
    with open(os.path.join(deep, "deep.py"), "w", encoding="utf-8") as f:
        f.write("import os\n")
    os.symlink(os.path.join(tmp_dir, "top.py"), os.path.join(tmp_dir, "link.py"))
    os.symlink(os.path.join(tmp_dir, "top.py"), os.path.join(deep, "link.py"))
    os.symlink(deep, os.path.join(tmp_dir, "linked"))
    for depth in ("1", "3"):
        code_tree.register(spark)
        got = {r.file_path for r in spark.read.format("codetree").option("path", tmp_dir).option("split_depth", depth)
               .option("extensions", ".py").load().collect()}
        assert {"link.py", "a/b/c/d/e/link.py", "a/b/c/d/e/deep.py", "top.py", "pkg/__init__.py"} <= got
        assert "pkg/setup.cfg" not in got and not any(p.startswith("linked") for p in got)
