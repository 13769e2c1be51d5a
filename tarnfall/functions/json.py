"""JSON functions that need a walk over the value; vectorised, invalid text gives null."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _each(change):
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                return change(json.loads(text))
            except (ValueError, RecursionError):
                return None

        return s.map(one, na_action="ignore")

    return run


def _snake_key(key: str) -> str:
    """A word begins at a capital behind a small letter or digit, and at the last capital of several before a small letter."""
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", key)
    return re.sub("[A-Z]", lambda m: m[0].lower(), parts)


def _snake(value):
    if isinstance(value, dict):
        return {k if k == "_meta" else _snake_key(k): v if k == "_meta" else _snake(v) for k, v in value.items()}
    return [_snake(v) for v in value] if isinstance(value, list) else value


def _cell(value) -> str:
    if isinstance(value, str):
        return '"' + value.replace('"', '\\"') + '"' if any(c in value for c in ',\n"') else value
    return json.dumps(value, ensure_ascii=False)


def _table(value) -> str | None:
    """An array of objects with the same keys, none nested, as ``[n]{a,b}:`` and a line each; else null."""
    if not isinstance(value, list) or not value or not isinstance(value[0], dict) or not value[0]:
        return None
    keys = list(value[0])
    if not all(isinstance(v, dict) and v.keys() == value[0].keys() and not any(isinstance(x, (dict, list)) for x in v.values()) for v in value):
        return None
    return "\n".join([f"[{len(value)}]{{{','.join(keys)}}}:", *("  " + ",".join(_cell(v[k]) for k in keys) for v in value)])


def _compact(value, depth: int = 0) -> str:
    line = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if not isinstance(value, (dict, list)) or len(line.encode()) <= 80:
        return line
    inner, close = "  " * (depth + 1), "  " * depth
    if isinstance(value, dict):
        return "{\n" + ",\n".join(f'{inner}"{k}": {_compact(v, depth + 1)}' for k, v in value.items()) + f"\n{close}}}"
    return "[\n" + ",\n".join(inner + _compact(v, depth + 1) for v in value) + f"\n{close}]"


@F.pandas_udf(StringType())
def compact(s: pd.Series) -> pd.Series:
    """JSON, alone or behind other text, with each value of up to 80 bytes on one line, if that is shorter; else the text as it is."""

    def one(text: str) -> str:
        trimmed = text.strip()
        start = next((k for k, c in enumerate(trimmed) if c in "{["), None)
        if start is None:
            return text
        try:
            short = _compact(json.loads(trimmed[start:]))
        except (ValueError, RecursionError):
            return text
        return trimmed[:start] + short if len(short.encode()) < len(trimmed[start:].encode()) else text

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def canonical(s: pd.Series) -> pd.Series:
    """Keys sorted at every level, arrays in their order, no white space."""
    return _each(lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")))(s)


@F.pandas_udf(StringType())
def snake_keys(s: pd.Series) -> pd.Series:
    """Keys in snake_case at every level."""
    return _each(lambda v: json.dumps(_snake(v), ensure_ascii=False, separators=(",", ":")))(s)


@F.pandas_udf(StringType())
def as_table(s: pd.Series) -> pd.Series:
    """Arrays of like objects as a table in text."""
    return _each(_table)(s)


@F.pandas_udf(StringType())
def first_object(s: pd.Series) -> pd.Series:
    """The first balanced JSON object inside a text, braces in strings not counted; null without one."""

    def one(text):
        decoder, at = json.JSONDecoder(), text.find("{")
        while at >= 0:
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
        return None

    return s.map(one, na_action="ignore")


def with_value(key: str, value):
    """A function of a column: its JSON objects with ``key`` set to ``value``; other values as they are, invalid text gives null."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return _each(lambda v: json.dumps(v | {key: value} if isinstance(v, dict) else v, ensure_ascii=False, separators=(",", ":")))(s)

    return run
