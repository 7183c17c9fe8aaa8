"""All queries of the library, without the language-model part."""

from __future__ import annotations

from tidewheel.functions import python_udfs, scalars
from tidewheel.operators import aggregates, changes, joins, patterns, shapes, sketches, temporal, windows
from tidewheel.sources import committed, formats
from tidewheel.streaming import events

FLAGSHIP = "pricing_summary"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (aggregates, joins, shapes, sketches, windows, temporal, patterns, changes, scalars, python_udfs, formats, committed, events):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
