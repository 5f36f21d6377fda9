"""What __spark_entry__ adds for this subpackage: the queries and the SQL they are held against."""

from __future__ import annotations

import corpus_pipeline
from sievework.llm.queries import ORACLE_SQL as OPERATOR_SQL
from sievework.llm.queries import QUERIES as OPERATOR_QUERIES

QUERIES = OPERATOR_QUERIES | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = OPERATOR_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
