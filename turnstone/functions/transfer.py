"""Closed-set transfer records: list literals, aliases, and answers that must choose one of a record's values."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.answers import decoded
from turnstone.functions.prompts import AMBIGUOUS
from turnstone.shipping import ship

#: Bounds of a literal and of its values.
MOST_CHARS, MOST_VALUES = 10_000, 100


def folded(value: str) -> str:
    return " ".join(value.casefold().split())


def list_of(literal: str | None) -> list[str] | None:
    """The strings of a Python list literal; None if it isn't one, has none or too many, or two that are alike but for case and spaces."""
    try:
        values = ast.literal_eval(literal) if literal and len(literal) <= MOST_CHARS else None
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return None
    if not isinstance(values, list) or not 1 <= len(values) <= MOST_VALUES or not all(isinstance(v, str) and v.strip() for v in values):
        return None
    return values if len({folded(v) for v in values}) == len(values) else None


def literal_list(literal: Column) -> Column:
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(list_of)

    return run(literal)


def resolved(value: Column, candidates: Column, aliases: Column) -> Column:
    """The candidate that a value names, by itself or by the alias at its place, but for case and spaces; the mark of ambiguity stays; else null."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    pairs = F.arrays_zip(candidates.alias("c"), aliases.alias("a"))
    hit = F.filter(pairs, lambda p: (fold(p["c"]) == fold(value)) | (fold(p["a"]) == fold(value)))
    return F.when(fold(value) == AMBIGUOUS, AMBIGUOUS).otherwise(F.try_element_at(hit, F.lit(1))["c"])


def read(raw: str | None, finish: str | None, candidates: list[str]) -> dict:
    """The answer's request and value, or {"invalid_reason": ...}."""
    data, reason = decoded(raw, finish)
    if not reason and (not isinstance(data, dict) or data.keys() != {"request", "value"} or not isinstance(data["request"], bool) or not isinstance(data["value"], str)):
        reason = "schema"
    if not reason and data["value"] not in {*candidates, AMBIGUOUS}:
        reason = "transfer_value"
    return {"invalid_reason": reason} if reason else dict(data)


def parsed(raw: Column, finish: Column, candidates: Column) -> Column:
    """struct<invalid_reason, request, value> of answers, each against its record's candidates."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("invalid_reason string, request boolean, value string")
    def run(r: pd.Series, f: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [read(x, y, list(z) if z is not None else []) for x, y, z in zip(r, f, c, strict=True)]
        return pd.DataFrame({k: pd.Series([x.get(k) for x in rows], dtype=object) for k in ("invalid_reason", "request", "value")})

    return run(raw, finish, candidates)
