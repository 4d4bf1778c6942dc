"""Edge tables for the scalar expressions and checked operators (FIXTURES §4)."""
import pytest
from pyspark.sql import functions as F

from codeweave.functions.paths import splitext_ext, with_suffix
from codeweave.functions import mappings as M
from codeweave.operators import generation as GEN
from codeweave.operators import indexing as IX
from codeweave.operators import analysis as A


def one_col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    return [r[0] for r in df.select(fn("p")).collect()]


def test_splitext(spark):
    cases = {".env": "", "a/.env": "", "foo.env": ".env", "a.tar.gz": ".gz", "..x": "", "x.": ".", "a.b/c": ""}
    got = one_col(spark, list(cases), splitext_ext)
    assert got == list(cases.values())


def test_with_suffix(spark):
    cases = {"a.tar.gz": "a.tar.txt", "x": "x.txt", ".env": ".env.txt", "d.x/y": "d.x/y.txt"}
    assert one_col(spark, list(cases), lambda c: with_suffix(c, ".txt")) == list(cases.values())


def test_language_maps():
    assert ".py" in M.source_extensions("python")
    with pytest.raises(ValueError):
        M.source_extensions("Python")          # source map is case-sensitive
    assert M.config_extensions(" Python ") == [".cfg", ".toml", ".ini", ".txt"]
    assert ".C" in M.source_extensions("c")
    # languages without a config map yield only a source pass
    assert [p[2] for p in M.pass_plan(["ansible"])] == [False]


def test_prune_size_and_ext(spark):
    rows = [("r", "build/a.py", 10, "x"), ("r", "src/build.py", 10, "x"), ("r", "build", 10, "x"),
            ("r", "ok/A.PY", 10, "x"), ("r", "big.py", 200001, "x"), ("r", "edge.py", 200000, "x"),
            ("r", "pkg/__init__.py", 3, "x\r\ny\rz")]
    files = spark.createDataFrame(rows, "git_repo string, file_path string, size_bytes long, code string")
    kept = {r.file_path: r.code for r in GEN.select_passes(files, ["python"]).collect()}
    assert set(kept) == {"src/build.py", "edge.py", "pkg/__init__.py"}
    assert kept["pkg/__init__.py"] == "x\ny\nz"
    skipped = {r.file_path: r.reason for r in GEN.skipped_files(files, ["python"]).collect()}
    assert skipped == {"build/a.py": "pruned_dir", "big.py": "too_large"}


def test_invalid_utf8_skipped(spark):
    rows = [("r", "a.py", 2, bytearray(b"\xff\xfe")), ("r", "b.py", 4, bytearray(b"x\r\ny"))]
    files = spark.createDataFrame(rows, "git_repo string, file_path string, size_bytes long, content binary")
    out = {r.file_path: r.code for r in GEN.select_passes(files, ["python"]).collect()}
    assert out == {"b.py": "x\ny"}


def test_extract_json(spark):
    texts = ['a {"x":1} b', '[1] {"a":2}', "{a} {b}", None, "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = GEN.parse_metadata_text(df).select("i", F.to_json("metadata").alias("j"),
                                             GEN.variant_kind("metadata").alias("k")).orderBy("i").collect()
    assert got[0].j == '{"x":1}' and got[0].k == "object"
    assert got[1].k == "array"               # leftmost start wins, then rejected as a list
    assert got[2].j is None and got[3].j is None and got[4].j is None
    acc = GEN.accept_metadata(GEN.parse_metadata_text(df)).orderBy("i").collect()
    assert [r.reject_reason for r in acc] == [None, "not_an_object", "no_metadata", "no_metadata", "no_metadata"]


def test_accept_rejections(spark):
    texts = ["{}", '{"error":"x"}', '{"error":""}', "[]", '{"a": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    acc = GEN.accept_metadata(GEN.parse_metadata_text(df)).orderBy("i").collect()
    assert [r.reject_reason for r in acc] == ["no_metadata", "error", None, "not_an_object", None]


def test_flatten(spark):
    assert GEN.json_leaves('{"a": 1, "b": [1, {"c": null}], "e": []}') == [("a", "1", False), ("b_0", "1", False), ("b_1_c", None, False)]
    assert GEN.json_leaves('{"a_b": 1, "z": 0, "a": {"b": 2}}') == [("z", "0", False), ("a_b", "2", False)]
    assert GEN.json_leaves('{"a": {"b": 2}, "a_b": 1}') == [("a_b", "1", False)]
    assert GEN.json_leaves("[5]") == [("0", "5", False)]
    assert GEN.json_leaves("7") == [("", "7", False)]
    df = spark.createDataFrame([(1, 'x {"a":1,"b":[1,{"c":null}],"e":[]} y')], "i int, text string")
    got = {r.key: r.value for r in GEN.flatten_metadata(df, "text", ["i"]).collect()}
    assert got == {"a": "1", "b_0": "1", "b_1_c": None}


def test_header_java(spark):
    df = spark.createDataFrame(
        [("a.py", "java", False, "a.py", "repo", "p", "", ["x", "y"])],
        "file_path string, language string, is_config boolean, md_file_path string, md_git_repo string, "
        "package string, purpose string, imports array<string>")
    h = GEN.comment_header(df).select("header").first()[0]
    assert h == ("/*This file is located at a.py from repository repo.\n\n Package: p\n\nDependencies:\n"
                 "- a.py imports x\n- a.py imports y*/")


def test_header_config_by_extension(spark):
    df = spark.createDataFrame([("s.yaml", "python", True, "s.yaml", "r", None, "")],
                               "file_path string, language string, is_config boolean, md_file_path string, "
                               "md_git_repo string, package string, purpose string")
    assert GEN.comment_header(df).first().header == "#This file is located at s.yaml from repository r."


def test_target_winner(spark):
    rows = [(0, "a.py", "x"), (0, "a.pyi", "y"), (0, "setup.py", "s"), (1, "setup.cfg", "c")]
    df = spark.createDataFrame(rows, "pass_seq int, file_path string, code string").withColumn("header", F.lit(""))
    w = {r.target_path: r.file_path for r in GEN.target_path_winner(GEN.annotated_text(df)).collect()}
    assert w == {"a.txt": "a.pyi", "setup.txt": "setup.cfg"}


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert GEN.drop_columns(df, ["a"]).columns == ["b"]
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        GEN.drop_columns(df, ["y", "x"])
    with pytest.raises(ValueError):
        GEN.drop_columns(df, [])


def test_chunks(spark):
    def spans(n, size=5, overlap=1):
        text = " ".join(f"t{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        return [(r.start_token, r.start_token + r.n_tokens)
                for r in IX.chunk_text(df, size=size, overlap=overlap).orderBy("chunk_index").collect()]
    assert spans(12) == [(0, 5), (4, 9), (8, 12)]
    assert spans(9) == [(0, 5), (4, 9)]
    assert spans(1) == [(0, 1)]
    empty = spark.createDataFrame([(1, "  \n ")], "doc_id int, text string")
    assert IX.chunk_text(empty, size=5, overlap=1).count() == 0


def test_find_dependencies_edges(spark):
    rows = [(None, "t", "imports"), ("Os.Path", "t", "Imports x"), ("a", "b", None), ("ab", "c", "calls"),
            ("axb", "d", "depends on")]
    rel = spark.createDataFrame(rows, "source string, target string, description string")
    got = {r["from"]: r.weight for r in A.find_dependencies(rel, "os.path").collect()}
    assert got == {"Os.Path": 1.0}          # no weight column -> 1.0; '.' is a wildcard
    assert {r["from"] for r in A.find_dependencies(rel, "a.b").collect()} == {"axb"}
    assert A.find_dependencies(rel, "a.b", literal=True).count() == 0


def test_layers_few_targets(spark):
    rel = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "b"), ("s", "c")], "source string, target string") \
        .withColumn("description", F.lit("imports"))
    got = {}
    for r in A.dependency_layers(rel).collect():
        got.setdefault(r.layer, []).append((r.pos, r.module))
    assert sorted(got["leaf_modules"]) == [(0, "a"), (1, "c"), (2, "b")]
    assert "intermediate_modules" not in got
    assert sorted(got["top_modules"]) == [(0, "a"), (1, "c"), (2, "b")]


def test_versions_and_ranges(spark):
    from codeweave.functions import versions as V
    order = ["0.9", "1.0-alpha", "1.0-alpha.1", "1.0-alpha.2", "1.0-alpha.10", "1.0-beta", "1.0rc1", "v1.0.0", "1.0.1", "1.2", "1.10", "2", "10.0"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").withColumn("k", V.version_key(F.col("v")))
    assert [r.v for r in rows.orderBy("k").collect()] == order
    same = spark.createDataFrame([("1.2", "v1.2.0+build5"), ("1.2.0.0", "1.2")], "a string, b string").select((V.version_key(F.col("a")) == V.version_key(F.regexp_replace("b", r"\+.*", ""))).alias("e"))
    assert [r.e for r in same.collect()] == [True, True]
    assert rows.select(V.version_key(F.lit("latest")).alias("k")).first().k is None
    for text, version, want in ((">=1.2,<2", "1.10", True), (">=1.2,<2", "2.0", False), ("1.4", "1.4.0", True), ("==1.4", "1.5", False), (">1.0", "1.0", False), ("<=3", "3.0", True), ("", "9", True)):
        d = spark.range(1).select(V.range_bounds(F.lit(text)).alias("r"), V.version_key(F.lit(version)).alias("k"))
        low = F.col("r.low").isNull() | (F.col("r.low") < F.col("k")) | ((F.col("r.low") == F.col("k")) & ~F.col("r.low_open"))
        high = F.col("r.high").isNull() | (F.col("k") < F.col("r.high")) | ((F.col("r.high") == F.col("k")) & ~F.col("r.high_open"))
        assert d.select((low & high).alias("x")).first().x is want, (text, version)
