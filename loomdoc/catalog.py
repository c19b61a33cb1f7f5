"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import answers, chunks, evaluation, jobs, layers, parsing, store, stored, tables  # noqa: F401  (they register their queries)
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
