"""Prompt templates, answer schemas and hashes of documents, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{\{([a-z_]+)\}\}")
AMBIGUOUS = "<ambiguous>"


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """The template with each placeholder {{name}} replaced by its column. All names must occur, and no value may hold a brace pair.

    Placeholders that have no value stay, as a later step may fill them. A null value gives null.
    """
    parts = _PLACEHOLDER.split(template)
    if missing := set(values) - set(parts[1::2]):
        raise ValueError(f"the template lacks {sorted(missing)}")
    for name, c in values.items():
        values = {**values, name: F.when(c.rlike(r"\{\{|\}\}"), F.raise_error(F.lit(f"{name} holds placeholder braces"))).otherwise(c)}
    return F.concat(*[values.get(p, F.lit("{{" + p + "}}")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def closed_values(candidates: Column) -> Column:
    """A record's values to choose from: its candidates in order, and the mark of ambiguity if they lack it; null if there are none or two alike."""
    every = F.when(F.array_contains(candidates, AMBIGUOUS), candidates).otherwise(F.array_append(candidates, F.lit(AMBIGUOUS)))
    return F.when((F.size(candidates) > 0) & (F.size(F.array_distinct(every)) == F.size(every)), every)


def transfer_schema(candidates: Column) -> Column:
    """JSON Schema of the answer for one record, whose value must be one of ``closed_values``."""
    enum = F.to_json(closed_values(candidates))
    return F.concat(F.lit('{"additionalProperties":false,"properties":{"request":{"type":"boolean"},"value":{"enum":'), enum, F.lit(',"type":"string"}},"required":["request","value"],"type":"object"}'))


def content_hash(*columns: str, without: tuple[str, ...] = ()) -> Column:
    """Digest of a row as JSON with sorted keys and without the columns that don't count (run times, disclosures)."""
    return F.sha2(F.to_json(F.struct(*sorted(set(columns) - set(without))), {"ignoreNullFields": "false"}), 256)


def backoff(attempt: Column, key: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Full-jitter delay of an attempt (1, 2, ...): a share of base * 2^(attempt - 1), at most ``most``; the share is drawn by the md5 of key and attempt."""
    share = F.conv(F.substring(F.md5(F.concat_ws(":", key, attempt.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return share * F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
