"""Operations of a large-scale training-data pipeline. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from . import ctw, embedding_dedup, exact_dedup, langid, line_dedup, mixing, packing, pii, simhash, substring_dedup

_MODULES = (simhash, pii, ctw, packing, exact_dedup, langid, embedding_dedup, mixing, substring_dedup, line_dedup)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
