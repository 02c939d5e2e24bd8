"""Every operator as a named query over the driver tables, with its SQL twin.

``QUERIES[name](spark, folder)`` gives a DataFrame; ``SQL[name]`` computes the
same table in plain SQL over views of the same files.
"""

from __future__ import annotations

from . import charts, cleaning, counts, joining, models, pipelines, scanning, words
from .base import bigint_counts

MODULES = [counts, cleaning, joining, scanning, charts, models, words, pipelines]
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
SQL = {name: bigint_counts(sql) for m in MODULES for name, sql in m.SQL.items()}
