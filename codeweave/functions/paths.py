"""Path expressions as Catalyst column functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# os.path.splitext suffix: leading dots of the base name are never a suffix
# (".env" -> "", "x." -> ".", "a.tar.gz" -> ".gz", "..x" -> "").
_SPLITEXT_RE = r"^(?:.*/)?\.*[^/]*?[^./][^/]*?(\.[^./]*)$"
# pathlib with_suffix: drop only the last suffix of the final component.
_LAST_SUFFIX_RE = r"(?<=[^/])\.[^./]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def splitext_ext(path) -> Column:
    """Extension of the last path component, like ``os.path.splitext(p)[1]``."""
    return F.regexp_extract(_c(path), _SPLITEXT_RE, 1)


def with_suffix(path, suffix: str) -> Column:
    """``pathlib.Path(p).with_suffix(suffix)`` for relative POSIX paths."""
    return F.concat(F.regexp_replace(_c(path), _LAST_SUFFIX_RE, ""), F.lit(suffix))


def without_suffix(path) -> Column:
    return F.regexp_replace(_c(path), _LAST_SUFFIX_RE, "")


def dir_components(path) -> Column:
    """Folder names of a relative path (the file name itself excluded)."""
    parts = F.split(_c(path), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def relpath(path, root: str) -> Column:
    """Path relative to ``root`` (both POSIX, root without trailing slash)."""
    prefix = root.rstrip("/") + "/"
    return F.when(_c(path).startswith(prefix), F.substring(_c(path), len(prefix) + 1, 1 << 30)) \
        .otherwise(_c(path))
