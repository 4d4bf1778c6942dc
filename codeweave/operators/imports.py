"""Imports of source files and the files they mean (I4).

*Scan.*  One regular expression a language walks the text from left to right and drops
comments and strings as it meets them (a quote inside a comment opens nothing, a comment sign
inside a string neither); strings that belong to an import stay.  What is left is searched
for the language's import statements.

*Resolution.*  A name is turned into a path without its suffix and joined with the corpus:
a relative name against the importing file's folder, any other with the ends of all paths
(``src/app/db.py`` can be meant by ``src.app.db``, ``app.db`` or ``db``).  Of several files
the one nearest to the top is taken, then the first by name.  Names that meet no file stay,
with a null path: they are libraries.

All of it is column expressions and two equi-joins; a path has as many ends as folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DQ, _SQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
_C_COMMENTS = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
#: By language: what is dropped (group 1 stays), patterns of imports, suffixes, whether a dot parts folders.
LANGUAGES = {
    "python": (rf'"""[\s\S]*?(?:"""|\z)|\'\'\'[\s\S]*?(?:\'\'\'|\z)|#[^\n]*+|{_DQ}|{_SQ}|()(?!)',
               (r"(?m)^[ \t]*import[ \t]+([^\n;]+)", r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b"), (".py", ".pyi"), True),
    "java": (rf'"""[\s\S]*?(?:"""|\z)|{_C_COMMENTS}|{_DQ}|{_SQ}|()(?!)', (r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",), (".java", ".kt"), True),
    "javascript": (rf"((?:\bfrom|\bimport|\brequire\s*\()\s*(?:{_DQ}|{_SQ}))|{_C_COMMENTS}|{_DQ}|{_SQ}|`[^`\\]*+(?:\\.[^`\\]*+)*+`?",
                   (r"""(?:\bfrom|\bimport|\brequire\s*\()\s*["']([^"'\n]+)["']""",), (".js", ".ts", ".jsx", ".tsx"), False),
    "c++": (rf"((?m:^)[ \t]*#[ \t]*include[ \t]*(?:{_DQ}|<[^>\n]*>))|{_C_COMMENTS}|{_DQ}|{_SQ}",
            (r"""(?m)^[ \t]*#[ \t]*include[ \t]*["<]([^">\n]+)[">]""",), (".h", ".hpp", ".c", ".cc", ".cpp", ".cxx"), False),
    "ruby": (rf"(\brequire(?:_relative)?\b[ \t(]*(?:{_DQ}|{_SQ}))|(?m:^=begin)[\s\S]*?(?:(?m:^=end)|\z)|#[^\n]*+|{_DQ}|{_SQ}",
             (r"""(?m)^[ \t]*require(?:_relative)?[ \t(]*["']([^"'\n]+)["']""",), (".rb",), False),
}


def strip(code: Column, language: str) -> Column:
    """The text without comments and strings, but for those of imports."""
    return F.regexp_replace(code, F.lit(LANGUAGES[language][0]), F.lit("$1"))


def _names(code: Column, language: str) -> Column:
    clean = strip(F.coalesce(code, F.lit("")), language)
    found = F.concat(*[F.regexp_extract_all(clean, F.lit(p), 1) for p in LANGUAGES[language][1]])
    if language == "python":  # "import a.b as c, d"
        found = F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(y, r"^\s*([.\w]+)", 1))))
    return F.array_remove(F.array_distinct(found), "")


def import_names(files: DataFrame) -> DataFrame:
    """``(file_path, language, name)`` of ``files(file_path, language, code)``: distinct imports, also of relative names."""
    names = F.array().cast("array<string>")
    for language in LANGUAGES:
        names = F.when(F.col("language") == language, _names(F.col("code"), language)).otherwise(names)
    return files.where(F.col("language").isin(*LANGUAGES)).select("file_path", "language", F.explode(names).alias("name"))


def _stem(path: Column, language: Column) -> Column:
    """A path without its suffix; a package's ``__init__`` and a folder's ``index`` stand for the folder."""
    s = F.regexp_replace(path, r"\.[A-Za-z]+$", "")
    s = F.when(language == "python", F.regexp_replace(s, r"(^|/)__init__$", "")).when(language == "javascript", F.regexp_replace(s, r"/index$", "")).otherwise(s)
    return s


def _normal(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``; names that leave the tree are null."""
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc)
                       .when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(x == "..", F.lit(None)).otherwise(F.concat(acc, F.array(x))), lambda acc: F.array_join(acc, "/"))


def wanted(names: DataFrame) -> DataFrame:
    """``names`` with ``relative`` and ``want``, the path without suffix that a name means."""
    lang, name = F.col("language"), F.col("name")
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    up = F.expr("repeat('../', greatest(length(regexp_extract(name, '^([.]*)', 1)) - 1, 0))")
    dotted = F.translate(F.regexp_replace(name, r"^\.+", ""), ".", "/")
    plain = F.regexp_replace(name, r"\.(?:h|hpp|c|cc|cpp|cxx|rb|js|ts|jsx|tsx)$", "")
    relative = F.when(lang == "python", dots > 0).when(lang == "javascript", name.startswith(".")).otherwise(F.lit(False))
    path = F.when((lang == "python") & (dots > 0), _normal(F.concat(folder, up, dotted))).when(lang.isin("python", "java"), dotted) \
        .when(lang == "javascript", F.when(name.startswith("."), _normal(F.concat(folder, plain))).otherwise(plain)).otherwise(plain)
    return names.withColumns({"relative": relative, "want": path})


def resolve_imports(files: DataFrame) -> DataFrame:
    """``(source, language, name, target)``: imports of ``files`` and the files they mean, null where there is none."""
    w = wanted(import_names(files))
    own = files.where(F.col("language").isin(*LANGUAGES)).select("language", F.col("file_path").alias("target"), _stem(F.col("file_path"), F.col("language")).alias("stem"))
    parts = F.split("stem", "/")
    ends = own.select("language", "target", F.size(parts).alias("depth"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("want"), (i == 1).alias("whole")))).alias("e")) \
        .select("language", "target", "depth", "e.want", "e.whole").where("want <> ''")
    best = F.min_by("target", F.struct("depth", "target"))
    # one file an end, and one a whole path: the join adds no rows
    by_end = ends.groupBy("language", "want").agg(best.alias("by_end"))
    by_path = ends.where("whole").groupBy("language", "want").agg(best.alias("by_path"))
    out = w.join(by_end, ["language", "want"], "left").join(by_path, ["language", "want"], "left")
    target = F.when(F.col("relative"), F.col("by_path")).otherwise(F.coalesce("by_path", "by_end"))
    return out.select(F.col("file_path").alias("source"), "language", "name", target.alias("target"))
