"""Report index, index publishing, running sums and the Index API against brute force."""
import contextlib
import io
import json
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweave.functions.ranks import running_sums
from codeweave.operators import communities as CM
from codeweave.operators import report_index as RI
from codeweave.operators import search as S
from codeweave.plans import index_build as IB
from codeweave.sources import index_io


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def bm25(reports, terms):
    bags = {c: Counter(words(" ".join(x for x in (s, f) if x is not None))) for c, s, f in reports}
    n, total = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for c, b in bags.items():
        s = sum(math.floor(1000 * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) * (2200000000 * b[t] // (1000 * b[t] + 300 + 900 * sum(b.values()) * n // total))
                for t in set(terms) if t in b)
        if s > 0:
            out[c] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("block", [4, 128])
def test_top_reports_equal_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(RI, "BLOCK", block)  # 4: most blocks are ruled out by their bounds
    rng = random.Random(block)
    vocab = ["auth", "Database", "é", "cache", "queue", "module"] + [f"w{i}" for i in range(60)]
    reports = [(f"{i % 3}:c{i}", " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))), rng.choice([None, "a-b_c", " ".join(rng.choices(vocab, k=40))])) for i in range(150)]
    reports += [("2:same", *reports[5][1:]), ("2:none", None, None)]
    df = spark.createDataFrame(reports, "community string, summary string, full_content string")
    index = {k: t.cache() for k, t in RI.build(df).items()}
    for terms in (["auth", "w3", "w9"], ["é", "database", "missing"], ["b", "c"], ["missing"], []):
        want = bm25(reports, terms)
        assert sorted(map(tuple, RI.scores(index, terms).collect())) == sorted(want)
        for k in (1, 7, 500):
            assert [tuple(r) for r in RI.top_reports(index, terms, k).collect()] == want[:k]
    qs = spark.createDataFrame([(0, ["auth", "w3", "w9"]), (1, ["missing"]), (2, ["é", "é"])], "question_no int, terms array<string>")
    got = RI.top_reports_by_question(index, qs, 5).orderBy("question_no", "rank").collect()
    assert [(r["question_no"], r["community"], r["score"]) for r in got] == [(q, *x) for q, t in ((0, ["auth", "w3", "w9"]), (2, ["é"])) for x in bm25(reports, t)[:5]]
    assert RI.top_reports(RI.build(df.limit(0)), ["auth"], 3).count() == 0


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 60), rng.randint(0, 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = running_sums(df, ["g"], ["o", "v"], "v", total="all").collect()
    assert sorted((r["g"] or "", r["o"], r["v"]) for r in got) == sorted((g or "", o, v) for g, o, v in rows)
    for g in ("hot", "a", "b", None):
        mine = sorted((r["before"], r["o"], r["v"], r["all"]) for r in got if r["g"] == g)
        total = sum(v for x, _, v in rows if x == g)
        at = 0
        for o, v in sorted((o, v) for x, o, v in rows if x == g):
            assert (at, o, v, total) in mine
            at += v
    ranks = running_sums(df, ["g"], ["o"]).groupBy("g").agg(F.sort_array(F.collect_list("before")).alias("r")).collect()
    assert all(r["r"] == list(range(len(r["r"]))) for r in ranks)


def _tables(spark, mark="one"):
    rels = spark.createDataFrame([("auth", "db", "auth imports db", 1.0), ("web", "auth", "web depends on auth", 2.0), ("db", "web", "db imports web", 1.0)],
                                 "source string, target string, description string, weight double")
    md = spark.createDataFrame([("auth.py", "pkg", ["db"], ["Auth"], "login", ["main"]), ("db.py", "pkg", [], ["Db"], "main", [])],
                               "file_path string, package string, imports array<string>, classes array<string>, method_name string, callees array<string>")
    corpus = spark.createDataFrame([("auth.txt", "auth.txt", f"{mark} text of auth"), ("db.txt", "db.txt", "text")], "id string, path string, text string")
    libs = spark.createDataFrame([("pom.xml", "log4j", "1.2", True, ["CVE-1"]), ("x.xml", "log4j", "2.0", False, [])],
                                 "file_path string, library_name string, library_version string, deprecated boolean, vulnerabilities array<string>")
    return IB.build_index(corpus, md, chunk_size=50, chunk_overlap=5, libraries=libs) | {}, rels


def test_index_api_over_reports(spark, tmp_dir):
    tables, _ = _tables(spark)
    root = os.path.join(tmp_dir, "index")
    assert index_io.write_index(tables, root) == 1
    idx = IB.Index(spark, root)
    assert {"report_postings", "methods", "libraries"} <= set(idx.tables)
    found = idx.global_search("what does AUTH.PY import").collect()
    assert found and all(r["used_tokens"] <= S.CONTEXT_BUDGET for r in found)
    assert all(r["n_tokens"] == len((r["summary"] + " " + r["full_content"]).split()) for r in found)
    sections = idx.migration_report(["Which package has auth.py?", "nothing matches"]).orderBy("question_no").collect()
    assert "AUTH.PY" in sections[0]["section"] and "entities around" in sections[0]["section"]
    assert "No relevant reports." in sections[1]["section"]
    seen = []

    def chat(messages):
        seen.extend(messages)
        return ["answer " + str(len(m[0]["content"]) > 50) for m in messages]

    assert idx.ask("auth.py", chat).first()["content"] == "answer True"
    assert {r["library_name"]: r["versions"] for r in idx.library_inventory().collect()} == {"log4j": "1.2,2.0"}
    assert {(r["caller"], r["callee"], r["resolved"]) for r in idx.call_graph().collect()} == {("main", "login", True)}
    assert idx.cycle_list().columns == ["scc", "length", "cycle"]


def test_a_failed_write_leaves_the_old_index(spark, tmp_dir):
    tables, _ = _tables(spark)
    root = os.path.join(tmp_dir, "index")
    index_io.write_index(tables, root)
    new, _ = _tables(spark, "two")
    boom = F.udf(lambda x: 1 / 0, "string")
    bad = dict(new, community_reports=new["community_reports"].withColumn("summary", boom("summary")))
    with pytest.raises(Exception):
        index_io.write_index(bad, root)
    assert index_io.current_run(spark, root)[0] == 1
    assert IB.Index(spark, root).tables["text_units"].where("text like 'one%'").count() == 1
    with pytest.raises(ValueError):
        index_io.write_index(dict(new, entities=new["entities"].drop("title")), root)
    assert index_io.write_index(new, root) == 2
    assert IB.Index(spark, root).tables["text_units"].where("text like 'two%'").count() == 1
    assert index_io.load_index(spark, root, version=1)["text_units"].where("text like 'one%'").count() == 1
    with pytest.raises(ValueError):
        index_io.load_index(spark, os.path.join(tmp_dir, "none"))


def test_library_rows(spark):
    md = json.dumps({"methods": [{"library_name": "a", "library_version": "1", "deprecated": True, "vulnerabilities": ["CVE-2"]}, {"method_name": "f"}]})
    ann = spark.createDataFrame([("pom.xml", md)], "file_path string, t string").select("file_path", F.parse_json("t").alias("metadata"))
    assert [tuple(r) for r in IB.library_rows(ann).collect()] == [("pom.xml", "a", "1", True, ["CVE-2"])]


def _exchanges(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return len(re.findall(r"Exchange (?:hash|range)partitioning", out.getvalue()))


def test_reports_are_shuffled_once_for_the_postings(spark):
    rows = [("0:a", "x y x", None), ("0:b", "Y z", "z Z")]
    df = spark.createDataFrame(rows, "community string, summary string, full_content string")
    index = RI.build(df)
    assert _exchanges(index["report_postings"]) == 1  # whole reports to their blocks, not a row a word
    twice = RI.build(df.unionByName(df.limit(1)))  # a community given twice counts as one report of both, as before
    for made in (index, twice):
        assert {(r["term"], d["community"]) for r in made["report_postings"].collect() for d in r["docs"]} == {("x", "0:a"), ("y", "0:a"), ("y", "0:b"), ("z", "0:b")}
    assert {r["term"]: r["df"] for r in index["report_terms"].collect()} == {"x": 1, "y": 2, "z": 1}
    assert {r["term"]: r["df"] for r in twice["report_terms"].collect()} == {"x": 1, "y": 2, "z": 1}


def test_reports_of_large_and_small_communities(spark, monkeypatch):
    """Degrees, inner edges both ways, loops, repeated members; salted or not, the members are the same."""
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 1.0), ("a", "a", 5.0), ("a", "b", None), ("c", "a", 1.0), ("d", "e", 1.0), (None, "a", 1.0)],
                                  "source string, target string, weight double")
    member = spark.createDataFrame([(0, "0:x", None, n) for n in "abcc"] + [(0, "0:y", None, n) for n in "def"] + [(1, "1:x", "0:x", "a"), (1, "1:x", "0:x", "b")],
                                   "level int, community string, parent string, node string")
    seen = []
    for limit in (100_000, 3):
        monkeypatch.setattr(CM, "ONE_TASK", limit)
        seen.append({r["community"]: (r["title"], r["size"], r["n_edges"], r["rank"], r["full_content"].split("\n")[3:]) for r in CM.community_reports(member, edges, 2).collect()})
    assert seen[0] == seen[1] == {
        "0:x": ("a", 4, 5, 11.0, ["a (degree 2)", "b (degree 1)"]), "0:y": ("d", 3, 1, 2.0, ["d (degree 1)", "e (degree 1)"]), "1:x": ("a", 2, 3, 9.0, ["a (degree 2)", "b (degree 1)"])}
    reports = spark.createDataFrame([], "community string, summary string")
    told = {(r["community"], r["text"]): (r["child"], r["used_tokens"]) for r in CM.nested_context(member.distinct(), edges, reports).where("kind = 'relationship'").collect()}
    assert set(told) == {("0:x", "a -> b"), ("0:x", "b -> a"), ("0:x", "c -> a"), ("0:y", "d -> e"), ("1:x", "a -> b"), ("1:x", "b -> a")}
    assert told[("0:x", "a -> b")][0] == "1:x" and told[("0:x", "c -> a")][0] is None


def test_search_keeps_the_documented_columns(spark):
    reports = spark.createDataFrame([("0:a", 0, "a", "auth here", "auth"), ("1:b", 1, "b", "auth auth", "more auth"), ("0:c", 0, "c", "nothing", "none")],
                                    "community string, level int, title string, summary string, full_content string")
    comm = spark.createDataFrame([("0:a", 0, None), ("1:b", 1, "0:a"), ("0:c", 0, None)], "community string, level int, parent string")
    tables = {"community_reports": reports, "communities": comm, **RI.build(reports)}
    found = S.search_reports(tables, "auth")
    assert found.columns == ["community", "level", "parent", "title", "summary", "full_content", "n_tokens", "score", "rank", "used_tokens"]
    assert [(r["community"], r["parent"], r["full_content"], r["rank"]) for r in found.collect()] == [("1:b", "0:a", "more auth", 1)]
