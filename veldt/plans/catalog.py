"""The registry of queries over the driver's tables."""

from __future__ import annotations

from veldt.plans import aggregates, annotations, durable, events, identities, layout, positions, preparation, relational, retrieval, round_trips, texts

REGISTRIES = (relational.R, aggregates.R, retrieval.R, texts.R, events.R, preparation.R, identities.R, annotations.R, round_trips.R, durable.R, layout.R, positions.R)


def queries() -> dict:
    return {name: run for r in REGISTRIES for name, run in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
