"""Imports outside comments and strings, resolved to files of the corpus."""
from pyspark.sql import functions as F

from codeweave.operators import imports as IM

PY = '''"""import doc
from doc import x"""
import os, app.db as db  # import hidden
from .util import a
from ..core.base import b; x = "import s1"
    import app.late
s = 'it\\'s # no comment'
# from commented import y
t = \'\'\'
import inside
\'\'\'
from app import web
'''
JS = """// import x from './no1'
import a from './a'; /* require('./no2') */
const b = require("../lib/b.js"); const s = "require('./no3')";
import 'side'; export * from './c';
const t = `import z from './no4'`;
"""
C = """#include <stdio.h>
// #include "no.h"
# include "util/list.h"
char *s = "#include <no2.h>"; /* "
#include "no3.h"
*/
"""
JAVA = 'package p;\nimport com.acme.Db;\n// import com.acme.No;\nimport static com.acme.Util.run;\nString s = "\\nimport x.Y;";\n/* import z.Z; */\nimport com.acme.*;\n'
RUBY = "require 'json'\nrequire_relative 'models/user'\n# require 'no'\n=begin\nrequire 'no2'\n=end\nx = \"require 'no3'\"\n"


def test_names_and_targets(spark):
    rows = [("src/app/sub/m.py", "python", PY), ("src/app/db.py", "python", ""), ("src/app/sub/util.py", "python", None), ("src/app/core/base.py", "python", ""),
            ("src/app/web/__init__.py", "python", ""), ("src/app/__init__.py", "python", ""), ("deep/er/src/app/db.py", "python", ""),
            ("ui/x/main.js", "javascript", JS), ("ui/x/a.ts", "javascript", ""), ("ui/lib/b.js", "javascript", ""), ("ui/x/c/index.js", "javascript", ""), ("ui/x/no1.js", "javascript", ""),
            ("c/main.c", "c++", C), ("c/util/list.h", "c++", ""), ("j/com/acme/Db.java", "java", ""), ("j/p/M.java", "java", JAVA),
            ("r/app.rb", "ruby", RUBY), ("r/models/user.rb", "ruby", ""), ("x.txt", "other", "import a")]
    got = {(r["source"], r["name"]): r["target"] for r in IM.resolve_imports(spark.createDataFrame(rows, "file_path string, language string, code string")).collect()}
    m, js = "src/app/sub/m.py", "ui/x/main.js"
    assert got == {
        (m, "os"): None, (m, "app.db"): "src/app/db.py", (m, ".util"): "src/app/sub/util.py", (m, "..core.base"): "src/app/core/base.py",
        (m, "app.late"): None, (m, "app"): "src/app/__init__.py",
        (js, "./a"): "ui/x/a.ts", (js, "../lib/b.js"): "ui/lib/b.js", (js, "side"): None, (js, "./c"): "ui/x/c/index.js",
        ("c/main.c", "stdio.h"): None, ("c/main.c", "util/list.h"): "c/util/list.h",
        ("j/p/M.java", "com.acme.Db"): "j/com/acme/Db.java", ("j/p/M.java", "com.acme.Util.run"): None,
        ("r/app.rb", "json"): None, ("r/app.rb", "models/user"): "r/models/user.rb"}


def test_long_and_broken_code(spark):
    rows = [("a.py", "python", "x = '" + "a" * 200_000 + "'\nimport end"), ("b.py", "python", '"""' + "import no\n" * 50_000), ("c.js", "javascript", "/*" + "x" * 200_000),
            ("d.py", "python", "\\" * 100_000), ("e.c", "c++", '"' + "\\a" * 100_000)]
    df = spark.createDataFrame(rows, "file_path string, language string, code string")
    assert {(r["file_path"], r["name"]) for r in IM.import_names(df).collect()} == {("a.py", "end")}
    assert IM.resolve_imports(df.limit(0)).count() == 0


def test_relative_names_that_leave_the_tree(spark):
    df = spark.createDataFrame([("a.py", "python", "from ...x import y\nfrom . import z"), ("x.py", "python", "")], "file_path string, language string, code string")
    assert {r["name"]: r["target"] for r in IM.resolve_imports(df).collect()} == {"...x": None, ".": None}
    assert df.where(F.col("code") == "").count() == 1
