"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERY (name, function) and, where SQL can express it, ORACLE.
MODULES = (
    "secrets_scan",
    "token_counts",
    "language_id",
    "mixing",
    "chat_format",
    "audio",
    "warc",
    "ngram_join",
    "piece_sampling",
    "embedding_dedup",
)

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"threadloom.llm.{_name}")
    QUERIES[_module.QUERY[0]] = _module.QUERY[1]
    if getattr(_module, "ORACLE", None):
        ORACLES[_module.QUERY[0]] = _module.ORACLE
