"""H1, H2: user analyzers and tools.

An analyzer is registered for file extensions with a function from a pandas batch of files
``(repo_id, path, content)`` to a pandas frame of findings (``file, line, severity, category,
title, description, auto_fixable`` and optionally ``stage``). Each runs with ``mapInPandas`` over
the files with its extensions; results are completed (ids, stage order) and unioned. Tools are
plain DataFrame → DataFrame functions (every operator in ``revline.operators``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.operators.detectors import complete_findings
from revline.operators.synthesis import union_findings
from revline.schema import STAGE_ORDER

ANALYZER_OUTPUT = ("repo_id string, file string, line int, severity string, category string, title string, "
                   "description string, auto_fixable boolean, stage string")
_ANALYZERS: dict[str, tuple[list[str], Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def register_analyzer(name: str, extensions: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    _ANALYZERS[name] = (list(extensions), fn)


def unregister_analyzer(name: str) -> None:
    _ANALYZERS.pop(name, None)


def analyzers() -> dict[str, list[str]]:
    return {k: v[0] for k, v in _ANALYZERS.items()}


def _wrap(fn):
    cols = [c.split()[0] for c in ANALYZER_OUTPUT.split(", ")]

    def run(batches):
        for pdf in batches:
            out = fn(pdf)
            if out is None or len(out) == 0:
                continue
            out = out.copy()
            if "repo_id" not in out.columns:
                out["repo_id"] = None
            if "stage" not in out.columns:
                out["stage"] = "pattern"
            yield out[cols]
    return run


def run_analyzers(files: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    """All (or the named) registered analyzers over ``files``; ``None`` if none applies.

    The two that find nothing (Java, TypeScript) read no file.
    """
    frames = []
    stage_order = F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_ORDER.items() for x in kv]), F.col("stage"))
    for name, (exts, fn) in _ANALYZERS.items():
        if fn is _no_findings or (names is not None and name not in names):
            continue
        cond = None
        for e in exts:
            c = F.col("path").endswith(e)
            cond = c if cond is None else cond | c
        subset = files.filter(cond).select("repo_id", "path", "content")
        out = subset.mapInPandas(_wrap(fn), ANALYZER_OUTPUT)
        out = out.withColumn("stage_order", stage_order).withColumn("seq", F.coalesce("line", F.lit(0)).cast("long"))
        frames.append(complete_findings(out))
    return union_findings(*frames) if frames else None


# The reference's Java and TypeScript analyzers declare their extensions and return no findings.
def _no_findings(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(columns=["file", "line", "severity", "category", "title", "description", "auto_fixable"])


register_analyzer("java", [".java"], _no_findings)
register_analyzer("typescript", [".ts", ".tsx"], _no_findings)
