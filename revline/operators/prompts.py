"""Logic-review prompts per file and model responses turned into findings.

The model call itself is outside: the caller supplies a responses table (or a pandas_udf that
fills one). Persona lookup is a literal map in the projection, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: persona prompts, the instruction line and finding titles ----------------------
PERSONA_PROMPTS = {
    "architect": ("You are a Principal Software Architect with 30 years of experience. Your goal is to "
                  "ensure the code follows high-level design patterns and is built to last."),
    "mentor": ("You are a kind and patient Senior Developer Mentor. Help the developer understand their "
               "mistakes in an encouraging way, focusing on growth."),
    "security": ("You are a Cyber Security Expert. Your only mission is to find vulnerabilities, secrets, "
                 "and insecure practices. You are strict and uncompromising."),
}
DEFAULT_PERSONA = "architect"
INSTRUCTION_SRC = ("Analyze the following code for subtle logic bugs, edge cases, and architectural drift. "
                   "Return findings in a structured format.")
INSTRUCTION_ROOT = ("Analyze the following code for subtle logic bugs, edge cases, and architectural drift. "
                    "Respond briefly.")
TITLE_SRC = "Logic Intelligence Scan"
TITLE_ROOT = "Quick Logic Scan"
# ---------------------------------------------------------------------------------------------------


def persona_prompt(persona_id) -> Column:
    """Prompt of the persona; unknown or missing ids fall back to the architect."""
    pid = F.col(persona_id) if isinstance(persona_id, str) else persona_id
    m = F.create_map(*[F.lit(x) for kv in PERSONA_PROMPTS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.coalesce(pid, F.lit(DEFAULT_PERSONA))), F.lit(PERSONA_PROMPTS[DEFAULT_PERSONA]))


def review_prompts(files: DataFrame, persona_col: str | None = None, variant: str = "src",
                   max_code_chars: int | None = None, path: str = "path", code: str = "content") -> DataFrame:
    """One (system, human) prompt pair per file. The whole file is sent unless the caller asks for
    the root variant's cut with ``max_code_chars``."""
    instruction = INSTRUCTION_SRC if variant == "src" else INSTRUCTION_ROOT
    body = F.col(code) if max_code_chars is None else F.substring(F.col(code), 1, max_code_chars)
    pid = F.col(persona_col) if persona_col else F.lit(DEFAULT_PERSONA)
    return files.withColumn("system_prompt", F.concat(persona_prompt(pid), F.lit("\n" + instruction))) \
        .withColumn("human_prompt", F.concat(F.lit("File: "), F.col(path), F.lit("\n\nCode:\n"), body))


def responses_to_findings(prompts: DataFrame, responses: DataFrame, on: list[str], variant: str = "src",
                          path: str = "path", response: str = "response") -> DataFrame:
    """Model responses → medium / logic / auto-fixable findings at line 1.

    The description is the reference's summary (first 200 characters + ``...``, or 300 for the
    root variant); the whole response is kept in ``recommendation``. Prompts without a response
    (a failed call) give no finding.
    """
    title = TITLE_SRC if variant == "src" else TITLE_ROOT
    desc = F.concat(F.substring(F.col(response), 1, 200), F.lit("...")) if variant == "src" \
        else F.substring(F.col(response), 1, 300)
    keep = [c for c in prompts.columns if c == "repo_id" and c not in on]
    j = prompts.join(responses, on)
    return j.select(*keep, *on, F.col(path).alias("file"), F.lit(1).alias("line"), F.lit("medium").alias("severity"),
                    F.lit("logic").alias("category"), F.lit(title).alias("title"), desc.alias("description"),
                    F.col(response).alias("recommendation"), F.lit(True).alias("auto_fixable"))
