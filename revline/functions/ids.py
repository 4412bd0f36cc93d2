"""Deterministic finding ids: a content hash, so retries and re-runs give the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u001f"        # unit separator between fields
NULL_MARK = "\u0002"  # stands for a null field, so (null, 'x') and ('x', null) differ

ID_FIELDS = ["repo_id", "file", "line", "column", "category", "title", "description"]


def content_hash(*cols) -> Column:
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                        F.lit(NULL_MARK)) for c in cols]
    return F.sha2(F.concat_ws(SEP, *parts), 256)


def finding_id() -> Column:
    return content_hash(*ID_FIELDS)


def finding_id_sql(prefix: str = "") -> str:
    """The same hash as DuckDB SQL (used by the oracle queries)."""
    p = prefix
    parts = [f"coalesce(CAST({p}{c} AS VARCHAR), chr(2))" for c in
             ["repo_id", "file", "line", '"column"', "category", "title", "description"]]
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"
