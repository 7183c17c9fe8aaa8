"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage. QUERIES and ORACLE_SQL hold
what the driver entry registers.
"""

from tidewheel.llm.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
