"""``name -> DuckDB SQL`` for the queries of ``registry``."""

from __future__ import annotations

from . import changes, ingest, market, scanning, streams

ORACLE: dict[str, str] = {**market.ORACLE, **changes.ORACLE, **scanning.ORACLE, **ingest.ORACLE, **streams.ORACLE}
