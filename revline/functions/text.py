"""String helpers matching Python text semantics the reference relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: secret patterns, applied in this order, match -> prefix + 8 asterisks ---
SECRET_PATTERNS = [
    ("sk_token", r"(sk-)[a-zA-Z0-9]{32,}"),
    ("key_param", r"(key=)[a-zA-Z0-9-_]{20,}"),
]
SECRET_MASK = "********"
# -------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_newlines(c) -> Column:
    """Text-mode read: CRLF and lone CR become LF (texts without CR skip the regex)."""
    x = _col(c)
    return F.when(x.contains("\r"), F.regexp_replace(x, r"\r\n?", "\n")).otherwise(x)


def split_lines(c) -> Column:
    """``str.split('\\n')``: limit -1 keeps trailing empty strings."""
    return F.split(_col(c), "\n", -1)


def line_count(c) -> Column:
    return F.size(split_lines(c))


def py_title_from_snake(c) -> Column:
    """``s.replace('_', ' ').title()`` for identifier-like names."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def mask_secrets(c) -> Column:
    out = _col(c)
    for _, pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, "$1" + SECRET_MASK)
    return out


def decode_utf8_strict(b) -> Column:
    """Bytes to text; invalid UTF-8 gives null (the caller turns that into an error row)."""
    s = _col(b).cast("string")
    return F.when(F.is_valid_utf8(s), s)


def decode_utf8_ignore(b) -> Column:
    """``errors='ignore'``: drop undecodable bytes."""
    s = _col(b).cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.replace(F.make_valid_utf8(s), F.lit("\ufffd"), F.lit("")))
