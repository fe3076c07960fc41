"""The catalogue of queries: a function (spark, sf_dir) -> DataFrame by name, and the same question in SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


from . import claims, collections, graphs, knowledge, ledger, morphemes, policies, queue, records, relations, retrieval, selection, streams, wordparts  # noqa: E402, F401
