"""Queries of the reference's operators over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from loomdoc.plans import layout, storage, verification

QUERIES = verification.QUERIES | storage.QUERIES | layout.QUERIES
ORACLES = verification.ORACLES | storage.ORACLES | layout.ORACLES
