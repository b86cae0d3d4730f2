"""SQL twins of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

from oracle import advice, corpus, messages, sequences, stores, streams, telemetry

FAMILIES = [telemetry, advice, sequences, corpus, messages, streams, stores]


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in FAMILIES:
        out.update(family.SQL)
    return out
