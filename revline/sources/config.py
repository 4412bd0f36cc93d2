"""Repository configuration, defaults overlaid by the user's file with a shallow merge.

A user key replaces the default key whole, nested dicts included (a user ``auto_fix`` without
``safe_only`` loses the default ``safe_only``). Input is one JSON (or parsed YAML) document per
repository; top-level keys are split first so an explicitly empty key is kept as null, as the
dict merge does.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the two default configurations -------------------------------------------
DEFAULTS_ROOT = {
    "enabled_checks": ["static_analysis", "security_audit", "performance_analysis", "pattern_analysis",
                       "testing_assessment", "logic_verification"],
    "severity_threshold": "medium",
    "exclude_patterns": ["**/node_modules/**", "**/vendor/**", "**/*.test.js", "**/*.spec.py"],
    "auto_fix": {"enabled": True, "safe_only": True},
    "max_analysis_time": 600,
}
DEFAULTS_SRC = {
    "enabled_checks": ["static_analysis", "security_audit", "performance_analysis"],
    "severity_threshold": "medium",
    "auto_fix": {"enabled": True},
}
# ---------------------------------------------------------------------------------------------

KEY_TYPES = {
    "enabled_checks": "array<string>",
    "severity_threshold": "string",
    "exclude_patterns": "array<string>",
    "auto_fix": "struct<enabled:boolean,safe_only:boolean>",
    "max_analysis_time": "int",
    "skip_categories": "array<string>",
    "persona": "string",
}


def _default_col(key: str, defaults: dict) -> Column:
    if key not in defaults:
        return F.lit(None).cast(KEY_TYPES[key])
    return F.from_json(F.lit(json.dumps(defaults[key])), KEY_TYPES[key]) if KEY_TYPES[key] != "string" \
        and KEY_TYPES[key] != "int" else F.lit(defaults[key]).cast(KEY_TYPES[key])


def effective_config(repo_configs: DataFrame, variant: str = "root", text_col: str = "config_json") -> DataFrame:
    """``(repo_id, config_json)`` → one typed row per repo; a null/empty document means defaults."""
    defaults = DEFAULTS_ROOT if variant == "root" else DEFAULTS_SRC
    top = F.from_json(F.col(text_col), "map<string,string>")
    df = repo_configs.select("repo_id", top.alias("_m"))
    cols = []
    for key, typ in KEY_TYPES.items():
        raw = F.element_at(F.col("_m"), F.lit(key))
        if typ == "string":
            user = raw
        elif typ == "int":
            user = raw.try_cast("int")
        else:
            user = F.from_json(raw, typ)
        present = F.coalesce(F.map_contains_key(F.col("_m"), F.lit(key)), F.lit(False))
        cols.append(F.when(present, user).otherwise(_default_col(key, defaults)).alias(key))
    return df.select("repo_id", *cols)


def parse_yaml_config(text: str, variant: str = "root") -> dict:
    """One user file parsed on the driver (a few hundred bytes).

    The root loader turns a file that is no valid YAML into defaults; with ``variant="src"`` the error is
    raised. A missing yaml library raises for both: it says nothing about the file.
    """
    import yaml  # optional
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        if variant == "src":
            raise
        return {}
    return data or {}


def _yaml_document(text: str | None) -> tuple[str | None, str | None]:
    """(JSON of the document, error) of one YAML text; an empty document is an empty mapping."""
    import yaml  # optional
    if text is None:
        return None, None
    try:
        data = yaml.safe_load(text)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return None, f"Invalid YAML: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
    if data is None:
        return "{}", None
    if not isinstance(data, dict):
        return None, "Invalid YAML: not a mapping"
    return json.dumps({str(k): v for k, v in data.items()}, default=str), None


@F.pandas_udf(T.StructType([T.StructField("config_json", T.StringType()), T.StructField("error", T.StringType())]))
def _yaml_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_yaml_document(t) for t in text], columns=["config_json", "error"])


def configs_from_yaml(texts: DataFrame, text_col: str = "config_yaml") -> DataFrame:
    """(repo_id, config_json, error) of a table of YAML files, one for each repository, parsed on the executors.

    The result goes into ``effective_config``: a file that cannot be read has a null document, so the defaults hold,
    and an error. A null text is no file: defaults, no error.
    """
    return texts.select("repo_id", _yaml_udf(F.col(text_col)).alias("c")).select("repo_id", "c.config_json", "c.error")


def yaml_errors(configs: DataFrame) -> DataFrame:
    """(repo_id, path, error) of the files that could not be read, as rows for the errors of a review."""
    return configs.where("error is not null").select("repo_id", F.lit(None).cast("string").alias("path"), "error")
