"""Corpus pipeline: language ID, SimHash near-dedup, substring dedup, secret scan, best-fit packing."""

from __future__ import annotations

from turnstone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
