"""Declarative five-block flow (prompt -> chat -> content -> text_parse -> drop) and sinks."""
import os

import pytest
from pyspark.sql import functions as F

from codeweave.operators import blocks as B
from codeweave.operators import completion as C
from codeweave.operators import generation as GEN
from codeweave.sources import index_io


def flow(cache):
    return [
        {"block_type": "prompt", "block_config": {"output_cols": "extract_metadata_prompt"}},
        {"block_type": "chat", "block_config": {"input_cols": "extract_metadata_prompt",
                                                "output_cols": "extracted_code_metadata",
                                                "chat_fn": C.echo_metadata_stub, "model": "stub",
                                                "cache_path": cache}},
        {"block_type": "content", "block_config": {"input_cols": "extracted_code_metadata",
                                                   "output_cols": "get_code_metadata_output_content"}},
        {"block_type": "text_parse", "block_config": {"input_cols": "get_code_metadata_output_content",
                                                      "output_cols": "extracted_data",
                                                      "start_tags": [""], "end_tags": [""]}},
        {"block_type": "drop", "block_config": {"input_cols": ["messages", "get_code_metadata_output_content",
                                                               "extracted_code_metadata"]}},
    ]


def test_five_block_flow(spark, tmp_dir):
    df = spark.createDataFrame([("r", "a.py", "python", "import os\nprint(1)")],
                               "git_repo string, file_path string, language string, code string")
    out = B.run_flow(df, flow(os.path.join(tmp_dir, "cache")), required=GEN.REQUIRED_COLUMNS)
    row = out.first()
    assert "extracted_data" in out.columns and "extracted_code_metadata" not in out.columns
    assert '"purpose": "import os' in row.extracted_data
    with pytest.raises(ValueError, match="missing required columns"):
        B.run_flow(df.drop("code"), flow(os.path.join(tmp_dir, "c2")), required=GEN.REQUIRED_COLUMNS)
    with pytest.raises(KeyError):
        B.run_flow(df, [{"block_type": "nope"}])


def test_metadata_text_and_csv(spark, tmp_dir):
    df = spark.createDataFrame([(0, "a.py", '{"b": [1, {"c": "x\\ny"}], "a": null}')],
                               "pass_seq int, file_path string, text string")
    flat = GEN.flatten_metadata(df, "text", ["pass_seq", "file_path"], types=True)
    txt = GEN.metadata_yaml(flat, ["pass_seq", "file_path"]).first().metadata_text
    assert txt == "a: null\nb_0: 1\nb_1_c: |-\n  x\n  y"
    md = GEN.parse_metadata_text(df)
    path = index_io.write_metadata_csv(md.select("file_path", "metadata"), tmp_dir, "python", False, 123)
    assert path.endswith("data_python__123.csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert back.count() == 1 and back.first().file_path == "a.py"


def test_n_completions_and_options(spark, tmp_dir):
    seen = []

    def chat(msgs, **opts):
        seen.append(opts)
        return [f"answer {len(m)}" for m in msgs]
    df = spark.createDataFrame([("hi",)], "q string").select(
        F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content"))).alias("messages"))
    out = C.complete(df, chat, "m", None, n=3, options={"response_format": {"type": "json_object"}})
    rows = out.select("completion_index", "content").collect()
    assert sorted(r.completion_index for r in rows) == [0, 1, 2]
    assert len({r.content for r in rows}) == 1


def test_report_context_budget(spark):
    from codeweave.operators import communities as CM
    e = spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 30}", 1) for i in range(30)],
                              "source string, target string, weight long")
    m = CM.hierarchical_communities(e, max_size=10)
    ctx = CM.report_context(m, e, budget=12).toPandas()
    assert (ctx.used_tokens <= 12).all()
    for _, g in ctx.groupby(["level", "community"]):
        assert list(g.sort_values("used_tokens").kind)[0] == "entity"


def test_yaml_quoting(spark):
    text = '{"a": "yes", "b": true, "c": "1", "d": 1, "e": "x: y", "f": "#c", "g": "", "h": "it\'s", "i": "-1", "j": -1}'
    df = spark.createDataFrame([("a.py", text)], "file_path string, text string")
    got = GEN.metadata_yaml(GEN.flatten_metadata(df, "text", ["file_path"], types=True)).first().metadata_text
    assert got.split("\n") == ["a: 'yes'", "b: true", "c: '1'", "d: 1", "e: 'x: y'", "f: '#c'", "g: ''", "h: it's", "i: '-1'", "j: -1"]


def test_corpus_of_two_repositories(spark):
    """Equal paths in two repositories, a lost target path and a colliding key stay apart."""
    import json

    from codeweave.plans.index_build import prepare_corpus

    def model(messages):
        out = []
        for m in messages:
            body = m[-1]["content"]
            out.append(json.dumps({"purpose": "one" if "REPO1" in body else "two"}) if "BAD" not in body else "no json")
        return out

    rows = [("r1", "a/setup.py", "x = 1  # REPO1"), ("r2", "a/setup.py", "x = 1  # REPO2"), ("r1", "a/setup.cfg", "[m] # REPO1"),
            ("r1", "b.py", "# BAD"), ("r2", "b.py", "y = 2  # REPO2")]
    files = spark.createDataFrame([(g, p, c, len(c)) for g, p, c in rows], "git_repo string, file_path string, code string, size_bytes long")
    out = prepare_corpus(files, ["python"], model)
    ann = {(r.git_repo, r.file_path): r for r in out["annotated"].collect()}
    assert {k: r.purpose for k, r in ann.items() if k[1].endswith(".py")}.get(("r2", "a/setup.py")) == "two"
    assert all(("two" if k[0] == "r2" else "one") in r.metadata_text for k, r in ann.items())
    assert [(r.git_repo, r.file_path) for r in out["missing"].collect()] == [("r1", "b.py")]
    assert {(r.git_repo, r.file_path) for r in out["rejected"].collect()} == {("r1", "b.py")}
