"""Exclude globs to anchored regular expressions: on the driver for a list, as a Column for patterns in rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def globs_to_regex(globs) -> str | None:
    globs = list(globs or [])
    if not globs:
        return None
    return "|".join(f"(?:{glob_to_regex(g)})" for g in globs)


def globs_regex(globs: Column) -> Column:
    """One regular expression for an array of globs of a row; null without any."""
    def one(glob: Column) -> Column:
        # the marks stand for the wildcards while single stars are replaced
        out = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
        for wildcard, regex in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"),
                                ("\x01", "(?:.*/)?"), ("\x02", ".*")):
            out = F.replace(out, F.lit(wildcard), F.lit(regex))
        return F.concat(F.lit("(?:^"), out, F.lit("$)"))

    known = F.filter(globs, lambda g: g.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(F.transform(known, one), "|"))
