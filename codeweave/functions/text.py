"""Text and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First JSON-looking span: greedy object OR greedy list, DOTALL, leftmost start wins.
_JSON_SPAN_RE = r"(?s)\{.*\}|\[.*\]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_newlines(text) -> Column:
    """Text-mode read: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def decode_utf8(content) -> Column:
    """Binary -> string, null when the bytes are not valid UTF-8 (skip, don't fail)."""
    return F.when(F.is_valid_utf8(_c(content).cast("string")), _c(content).cast("string"))


def json_span(text) -> Column:
    """The first ``{...}``/``[...]`` span of a text (null when none)."""
    return F.nullif(F.regexp_extract(_c(text), _JSON_SPAN_RE, 0), F.lit(""))


def extract_json(text) -> Column:
    """Parse the first JSON span into VARIANT; any failure (or null input) gives null."""
    return F.try_parse_json(json_span(text))


def truthy_str(x) -> Column:
    return F.nullif(_c(x), F.lit("")).isNotNull()


def truthy_arr(x) -> Column:
    return F.coalesce(F.size(_c(x)) > 0, F.lit(False))

