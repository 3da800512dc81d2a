"""Queries of the reference's operators on the generic tables, each beside its SQL oracle."""

from __future__ import annotations

from tarmaq.queries import grouped, predictions, scalars, tracks, windows

_MODULES = (scalars, grouped, windows, predictions, tracks)


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return dict(sorted(out.items()))


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.ORACLES
    return dict(sorted(out.items()))
