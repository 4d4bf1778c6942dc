"""Lookup tables for languages, file extensions, pruned folders and comment delimiters.

The dictionaries are exposed two ways: as Python values (validated on the
driver, where an unknown language is a usage error) and as tiny DataFrames for
broadcast lookup joins.  Every table here has a fixed, proven size (a few dozen
rows), so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the reference behaviour exactly.
# ---------------------------------------------------------------------------

# Source-file extensions per language (case-sensitive; the language name is not normalised).
SOURCE_EXTENSIONS = {
    "java": [".java", ".kt"],
    "python": [".py", ".pyi"],
    "c++": [".c", ".h", ".i", ".C", ".cpp", ".cc", ".cxx"],
    "c": [".c", ".h", ".i", ".C", ".cpp", ".cc", ".cxx"],
    "javascript": [".js", ".ts"],
    "sql": [".sql"],
    "ruby": [".rb"],
    "shell": [".sh"],
    "ansible": [".yaml", ".yml"],
    "terraform": [".tf", ".tfvars"],
    "cloudformation": [".yaml", ".yml", ".json", ".template"],
    "puppet": [".pp", ".epp"],
}

# Config-file extensions per language (the language name is stripped and lower-cased).
CONFIG_EXTENSIONS = {
    "java": [".xml", ".gradle", ".properties", ".yaml", ".yml", ".json"],
    "python": [".cfg", ".toml", ".ini", ".txt"],
    "c++": [".cmake", ".mk"],
    "c": [".cmake", ".mk"],
    "javascript": [".json", ".yaml", ".yml"],
    "typescript": [".json", ".yaml", ".yml"],
    "sql": [".yaml", ".yml", ".json", ".ini"],
    "ruby": [".gemspec", ".yaml", ".yml"],
    "shell": [".env", ".conf", ".cfg"],
}

# Comment delimiters (begin, end) for config files, by extension.
CONFIG_COMMENT_DELIMITERS = {
    ".xml": ("<!--", "-->"),
    ".gradle": ("/*", "*/"),
    ".properties": ("#", ""),
    ".yaml": ("#", ""),
    ".yml": ("#", ""),
    ".json": ("/*", "*/"),
    ".cfg": ("#", ""),
    ".toml": ("#", ""),
    ".ini": ("#", ""),
    ".txt": ("#", ""),
    ".cmake": ("#", ""),
    ".mk": ("#", ""),
    ".gemspec": ("#", ""),
    ".env": ("#", ""),
    ".conf": ("#", ""),
}

# Folders pruned from the walk, per language (stripped and lower-cased name).
EXCLUDED_DIRS = {
    "java": ["vendor", "node_modules", ".git", "bower_components", "target", ".gradle"],
    "python": ["vendor", "node_modules", ".git", "__pycache__", ".venv", "dist", "build"],
    "javascript": ["vendor", "node_modules", ".git", "bower_components", "dist", "build", "coverage"],
    "sql": ["vendor", "node_modules", ".git"],
    "shell": ["vendor", "node_modules", ".git"],
    "ruby": ["vendor", "node_modules", ".git", ".bundle"],
    "c++": ["vendor", "node_modules", ".git", "build", "cmake-build-debug"],
    "c": ["vendor", "node_modules", ".git", "build", "cmake-build-debug"],
    "ansible": ["vendor", "node_modules", ".git"],
    "terraform": ["vendor", "node_modules", ".git", ".terraform"],
    "cloudformation": ["vendor", "node_modules", ".git"],
    "puppet": ["vendor", "node_modules", ".git"],
}

# Comment delimiters (begin, end) for source files, by language (case-sensitive).
SOURCE_COMMENT_DELIMITERS = {
    "java": ("/*", "*/"),
    "python": ('"""', '"""'),
    "c++": ("/*", "*/"),
    "c": ("/*", "*/"),
    "javascript": ("/*", "*/"),
    "sql": ("/*", "*/"),
    "ruby": ("=begin", "=end"),
    "shell": ("<< 'COMMENT'", "COMMENT"),
}

# Largest file accepted, in bytes; larger files are skipped (strict ">").
MAX_FILE_BYTES = 200_000

# ---------------------------------------------------------------------------


class UnknownLanguage(ValueError):
    pass


def source_extensions(language: str) -> list[str]:
    if language not in SOURCE_EXTENSIONS:
        raise UnknownLanguage(f"Language={language} has not been mapped")
    return SOURCE_EXTENSIONS[language]


def config_extensions(language: str) -> list[str]:
    key = language.strip().lower()
    if key not in CONFIG_EXTENSIONS:
        raise UnknownLanguage(f"Language={key} has not been mapped")
    return CONFIG_EXTENSIONS[key]


def excluded_dirs(language: str) -> list[str]:
    key = language.strip().lower()
    if key not in EXCLUDED_DIRS:
        raise UnknownLanguage(f"Language={key} has not been mapped")
    return EXCLUDED_DIRS[key]


def pass_plan(languages: list[str]) -> list[tuple[int, str, bool, list[str], list[str]]]:
    """Expand languages into ordered (pass_seq, language, is_config, extensions, pruned) passes.

    Source pass then config pass per language, in the given order.  A language
    with no config mapping yields no config pass (instead of aborting the run).
    """
    plan = []
    seq = 0
    for lang in languages:
        plan.append((seq, lang, False, source_extensions(lang), excluded_dirs(lang)))
        seq += 1
        try:
            plan.append((seq, lang, True, config_extensions(lang), excluded_dirs(lang)))
        except UnknownLanguage:
            pass
        seq += 1
    return plan


def pass_plan_df(spark: SparkSession, languages: list[str]) -> DataFrame:
    """The pass plan as a small DataFrame (bounded by 2 x #languages rows)."""
    rows = [(s, lang, cfg, exts, dirs) for s, lang, cfg, exts, dirs in pass_plan(languages)]
    return spark.createDataFrame(
        rows, "pass_seq int, language string, is_config boolean, extensions array<string>, "
              "pruned_dirs array<string>")


def delimiters_df(spark: SparkSession) -> DataFrame:
    """(kind, key, begin, end): kind 'language' or 'extension'; fixed 23 rows."""
    rows = [("language", k, b, e) for k, (b, e) in SOURCE_COMMENT_DELIMITERS.items()]
    rows += [("extension", k, b, e) for k, (b, e) in CONFIG_COMMENT_DELIMITERS.items()]
    return F.broadcast(spark.createDataFrame(rows, "kind string, key string, begin string, end string"))
