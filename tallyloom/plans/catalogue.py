"""All registered plans."""

from __future__ import annotations

from . import calls, counts, extras, files, inference, molecules, spans, studies, texts  # noqa: F401  each import registers its plans
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
