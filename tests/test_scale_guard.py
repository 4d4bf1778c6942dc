"""Scale guard: library code never pulls data to the driver except at
size-checked, bounded sites, and never uses localCheckpoint."""
import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parent.parent / "codeweave"
# file -> number of allowed .collect() calls (each bounded: checked query vectors, 3 report sections; MAX_CELLS centroids, a block of queries)
ALLOWED_COLLECT = {"operators/search.py": 2, "operators/vector_index.py": 2}


def sources():
    for p in sorted(LIB.rglob("*.py")):
        if p.relative_to(LIB).parts[0] == "llm":  # has a guard of its own, in tests/llm
            continue
        code = "\n".join(line for line in p.read_text().splitlines() if not line.strip().startswith("#"))
        yield p.relative_to(LIB).as_posix(), code


def test_no_local_checkpoint_or_rdd():
    for name, code in sources():
        assert not re.search(r"\.localCheckpoint\(", code), name
        assert not re.search(r"\.toPandas\(", code), name
        assert not re.search(r"\.rdd\b", code), name


def test_collect_only_at_bounded_sites():
    for name, code in sources():
        n = len(re.findall(r"\.collect\(\)", code))
        assert n == ALLOWED_COLLECT.get(name, 0), (name, n)


def test_import_edges(spark):
    from codeweave.operators.indexing import import_edges
    code = "import os.path\nfrom pkg.mod import x\nconst a = require('lodash')\n#include <stdio.h>\n  import os.path\n"
    df = spark.createDataFrame([("a.py", code)], "file_path string, code string")
    got = sorted(r.target for r in import_edges(df).collect())
    assert got == ["lodash", "os.path", "pkg.mod", "stdio.h"]
