"""All queries of the library by name, each with its DuckDB statement where SQL can express it."""

from . import bundles, cases, cohorts, records, scores, texts, timelines  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
