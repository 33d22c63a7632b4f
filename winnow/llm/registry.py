"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat, decontaminate, html, lexical, lm, mixing, negatives, pieces, quality, sharding, simhash, tokenids, urls

MODULES = (lm, mixing, simhash, tokenids, sharding, urls, quality, html, chat, decontaminate, pieces, lexical, negatives)


def queries() -> dict:
    return {name: getattr(module, name) for module in MODULES for name in vars(module) if name.startswith("op")}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
