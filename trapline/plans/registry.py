"""All queries of the engine and the DuckDB SQL each is checked against."""

from __future__ import annotations

from ..streaming.gate import streaming_gate
from .queries import HYBRID, ORACLE_SQL, QUERIES
from .scan_sql import scan_sql

QUERIES = {**QUERIES, "streaming_gate": streaming_gate}
ORACLE_SQL = {**ORACLE_SQL, "streaming_gate": scan_sql(HYBRID) + "SELECT video_id, i, rec AS recording, reason, started FROM t"}
