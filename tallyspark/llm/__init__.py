"""Training-data operators; nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` gather the registered ``opN_*`` queries and
their DuckDB counterparts.
"""

from __future__ import annotations


def queries() -> dict:
    from tallyspark.llm import registry

    return registry.queries()


def oracle_sql() -> dict[str, str]:
    from tallyspark.llm import registry

    return registry.oracle_sql()
