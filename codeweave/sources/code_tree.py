"""Source-tree scan as a Python Data Source (``spark.read.format("codetree")``).

Why not ``binaryFile``: Spark's file sources silently skip names starting with
``_`` or ``.`` (``__init__.py``, ``.github/...``), which a code scan must keep.

Distribution: the driver lists only the upper ``split_depth`` levels of folders;
each folder at that depth is an input partition whose task walks its subtree, and
files above it are dealt in groups.  Tasks prune excluded folders during the walk,
skip other extensions by name and oversized files by ``stat`` before reading (the
latter are emitted with null content so they can be reported), and read the rest
as bytes.  Decoding and newline normalisation happen JVM-side afterwards.  Links to
files are read, links to folders aren't followed, at every level.  Files that may
not be read or are gone by then are skipped; any other I/O error fails the task.
The tree must sit on storage every executor can read.

Options: ``path`` (root), ``git_repo``, ``prune`` (comma list of folder names),
``extensions`` (comma list, default all), ``max_bytes`` (default 200000),
``split_depth`` (default 3), ``group_files`` (files per partition above it).
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "git_repo string, file_path string, size_bytes long, content binary"


class _TreePart(InputPartition):
    def __init__(self, rel_dir: str | None, files: list[str] | None = None):
        super().__init__(rel_dir)
        self.rel_dir = rel_dir
        self.files = files


class CodeTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("codetree source needs option 'path'")
        self.repo = options.get("git_repo", "")
        self.prune = {p for p in (options.get("prune") or "").split(",") if p}
        self.max_bytes = int(options.get("max_bytes", 200_000))
        self.group = int(options.get("group_files", 1000))
        self.depth = int(options.get("split_depth", 3))
        self.extensions = {x for x in (options.get("extensions") or "").split(",") if x}

    def _wanted(self, name: str) -> bool:
        return not self.extensions or os.path.splitext(name)[1] in self.extensions

    def partitions(self):
        parts, files = [], []
        level = [""]
        for depth in range(self.depth + 1):
            below = []
            for folder in level:
                if depth == self.depth:
                    parts.append(_TreePart(folder))
                    continue
                for entry in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name):
                    rel = f"{folder}/{entry.name}" if folder else entry.name
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in self.prune:
                            below.append(rel)
                    elif entry.is_file() and self._wanted(entry.name):
                        files.append(rel)
            level = below
        for i in range(0, len(files), self.group):
            parts.append(_TreePart(None, files[i:i + self.group]))
        return parts or [_TreePart(None, [])]

    def _emit(self, rel_path: str):
        abs_path = os.path.join(self.root, rel_path)
        try:
            size = os.path.getsize(abs_path)
            if size > self.max_bytes:
                return (self.repo, rel_path, size, None)
            with open(abs_path, "rb") as f:
                return (self.repo, rel_path, size, f.read())
        except (PermissionError, FileNotFoundError):
            return None

    def read(self, partition: _TreePart):
        if partition.rel_dir is None:
            for name in partition.files or []:
                row = self._emit(name)
                if row is not None:
                    yield row
            return
        base = os.path.join(self.root, partition.rel_dir)
        for cur, dirs, files in os.walk(base):
            dirs[:] = sorted(d for d in dirs if d not in self.prune)
            for name in sorted(filter(self._wanted, files)):
                rel = os.path.relpath(os.path.join(cur, name), self.root).replace(os.sep, "/")
                row = self._emit(rel)
                if row is not None:
                    yield row


class CodeTreeDataSource(DataSource):
    @classmethod
    def name(cls):
        return "codetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CodeTreeReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(CodeTreeDataSource)


def read_code_tree(spark, root: str, git_repo: str = "", languages: list[str] | None = None,
                   max_bytes: int = 200_000):
    """Scan ``root`` into ``(git_repo, file_path, size_bytes, content)``.

    Folders excluded for *every* requested language are pruned during the walk;
    per-language pruning is applied later by ``select_passes``.
    """
    from codeweave.functions import mappings as M
    register(spark)
    prune: set[str] = set()
    extensions: set[str] = set()
    if languages:
        extensions = {x for _, _, _, exts, _ in M.pass_plan(languages) for x in exts}
        sets = [set(M.excluded_dirs(lang)) for lang in languages]
        prune = set.intersection(*sets)
    return (spark.read.format("codetree").option("path", root).option("git_repo", git_repo)
            .option("prune", ",".join(sorted(prune))).option("extensions", ",".join(sorted(extensions))).option("max_bytes", str(max_bytes)).load())
