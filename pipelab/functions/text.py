r"""Column expressions over model responses and pipeline code.

Built-in functions inside one projection, but for the test whether a text is JSON, which is
Arrow-batched. Whole texts are read; a text is never cut. ``\s`` at line starts means blanks other than a line break.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a pipeline's code has to define.
REQUIRED_FUNCTIONS = ["preprocess_data", "create_model_for_optuna", "train_final_model", "evaluate_model"]
REQUIRED_GLOBALS = ["MODEL_TYPE", "FE_STEPS_DESCRIPTION"]

# Fences, markers and limits of the response formats.
JSON_BLOCK = r"(?s)(?:^|\n)[ \t\r\f]*```json[^\n]*((?:\n.*?)??)(?:\n[ \t\r\f]*```|\z)"
BARE_OBJECT = r"(?s)\{.*?\}"
CODE_BLOCK = r"(?s)```(?:python\n)?(.*?)```"
CONTROL_CHARS = r"[\x00-\x1F\x7F]"
SHORT_RESPONSE = 20
HEADER_LINE = r"(?m)^# (?:Agent ID|Generation|Parent ID): [^\n]*\n?"

_CONTROL = re.compile(CONTROL_CHARS)


def strip(text: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


class _Repeated(Exception):
    pass


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Repeated
    return found


def normal_json(text: str | None) -> str | None:
    """The text if it is one JSON value, else null.

    A text with a repeated key is written anew, the last value of the key winning, and one
    with NaN or an infinity with that word as a string, so that any JSON reader takes it.
    Text nested too deeply for the parser is no value either; ``json_too_deep`` tells it.
    """
    if text is None:
        return None

    def constant(word: str):
        raise _Repeated

    try:
        json.loads(text, object_pairs_hook=_unique, parse_constant=constant)
        return text
    except _Repeated:
        return json.dumps(json.loads(text, parse_constant=str), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def _first_normal(candidates) -> str | None:
    for text in candidates if candidates is not None else ():
        found = normal_json(text)
        if found is None:
            found = normal_json(_CONTROL.sub("", text))
        if found is not None:
            return found
    return None


@F.pandas_udf(T.StringType())
def first_json(candidates: pd.Series) -> pd.Series:
    """Of each list of texts the first that is JSON, if need be without control characters."""
    return candidates.map(_first_normal)


@F.pandas_udf(T.StringType())
def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(normal_json)


@F.pandas_udf(T.BooleanType())
def json_too_deep(texts: pd.Series) -> pd.Series:
    """Whether a text nests brackets too deeply to be tested."""

    def deep(text: str | None) -> bool:
        try:
            json.loads(text or "0")
        except RecursionError:
            return True
        except ValueError:
            return False
        return False

    return texts.map(deep)


def is_json(text: Column) -> Column:
    """Whether a whole text is one JSON value."""
    return _normal(text).isNotNull()


def extract_json(text: Column) -> Column:
    """JSON text of a response: its first ```json block, else the first object in it that
    parses; null when there is none. A block that is never closed runs to the end."""
    block = F.regexp_extract(text, JSON_BLOCK, 1)
    objects = F.regexp_extract_all(text, F.lit(BARE_OBJECT), F.lit(0))
    return first_json(F.when(block != "", F.array(strip(block))).otherwise(objects))


def json_field(json_text: Column, name: str) -> Column:
    return F.get_json_object(json_text, f"$.{name}")


def extract_code_blocks(text: Column) -> Column:
    """All fenced blocks without their fence and language tag; empty ones left out."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(1)), strip)
    return F.filter(blocks, lambda b: b != "")


def repair_json(text: Column, keys: list[str]) -> Column:
    """JSON text repaired from common slips; null unless it parses and holds ``keys``.

    Taken from the first ```json to the last fence (else the whole text): Python
    constants, comment lines and trailing commas are made valid.
    """
    start = F.instr(text, "```json")
    last = F.length(text) - F.instr(F.reverse(text), "```") - 1  # 1-based place of the last fence
    fenced = F.substring(text, start + 7, last - start - 7)
    body = strip(F.when((start > 0) & (last > start + 7), fenced).otherwise(text))
    for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
        body = F.replace(body, F.lit(python), F.lit(json))
    lines = F.filter(F.split(body, "\n"), lambda s: ~F.regexp_like(s, F.lit(r"^\s*(?://|#)")))
    body = F.array_join(lines, "\n")
    for closing in ("]", "}"):
        body = F.replace(body, F.lit(",\n" + closing), F.lit("\n" + closing))
    body = _normal(body)
    complete = body.isNotNull()
    for k in keys:
        complete = complete & F.coalesce(F.array_contains(F.json_object_keys(body), k), F.lit(False))
    return F.when(complete, body)


def is_bad_response(text: Column) -> Column:
    """Empty, missing or too short to hold an answer."""
    return F.coalesce(F.length(text), F.lit(0)) < SHORT_RESPONSE


def missing_parts(code: Column) -> Column:
    """Required functions and globals that a line pattern does not find, in their order."""
    checks = [(n, rf"(?m)^\s*def {n}\s*\(") for n in REQUIRED_FUNCTIONS]
    checks += [(n, rf"(?m)^\s*{n}\s*=[^=]") for n in REQUIRED_GLOBALS]
    found = F.array(*[F.when(~F.regexp_like(code, F.lit(p)), F.lit(n)) for n, p in checks])
    return F.array_compact(found)


def code_findings(code: Column) -> Column:
    """struct<valid, missing>: whether the code defines all required parts, and which it lacks.

    A contract check by line patterns; code is neither run nor compiled, so no text can fail.
    """
    missing = missing_parts(F.coalesce(code, F.lit("")))
    return F.struct((F.size(missing) == 0).alias("valid"), missing.alias("missing"))


def _header(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^# {name}: ([^\n]*)", 1)


def parse_code_header(text: Column) -> Column:
    """struct<agent_id, generation, parent_id, code> of a pipeline file.

    The blank line that sets the header apart is not part of the code.
    """
    parent = F.trim(_header(text, "Parent ID"))
    code = F.regexp_replace(F.regexp_replace(text, HEADER_LINE, ""), r"\A\n", "")
    return F.struct(
        F.nullif(F.trim(_header(text, "Agent ID")), F.lit("")).alias("agent_id"),
        F.coalesce(F.try_to_number(F.nullif(F.trim(_header(text, "Generation")), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)).alias("generation"),
        F.when(~parent.isin("", "None"), parent).alias("parent_id"),
        code.alias("code"),
    )


def render_code_file(agent_id: Column, generation: Column, parent_id: Column, code: Column) -> Column:
    """Text of a pipeline file: three header lines, a blank line, the code."""
    return F.concat(
        F.lit("# Agent ID: "), agent_id.cast("string"),
        F.lit("\n# Generation: "), generation.cast("string"),
        F.lit("\n# Parent ID: "), F.coalesce(parent_id.cast("string"), F.lit("None")),
        F.lit("\n\n"), code,
    )


def metric_lines(metrics: Column) -> Column:
    """``- name: value`` per metric of a map, by name, with four decimals."""
    entries = F.array_sort(F.map_entries(metrics))
    known = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(known, lambda e: F.format_string("- %s: %.4f", e["key"], e["value"])), "\n")


PROMPT = """Improve this model pipeline.

# Task
{task}

# Current metrics
{metrics}

# Current code
```python
{code}
```

Answer with a JSON object that holds "suggestion" and "code"."""


def build_prompt(task: Column, metrics: Column, code: Column, template: str = PROMPT) -> Column:
    """Prompt text per row; ``template`` names {task}, {metrics} and {code}."""
    values = {"{task}": task, "{metrics}": metric_lines(metrics), "{code}": code}
    parts = [p for p in re.split(r"(\{task\}|\{metrics\}|\{code\})", template) if p]
    return F.concat(*[F.coalesce(values[p], F.lit("")) if p in values else F.lit(p) for p in parts])


def choose_code(response: Column, current: Column) -> Column:
    """Code of a response: its JSON ``code`` field, else its first block, else the current code."""
    named = F.nullif(json_field(extract_json(response), "code"), F.lit(""))
    return F.coalesce(named, F.get(extract_code_blocks(response), F.lit(0)), current)
