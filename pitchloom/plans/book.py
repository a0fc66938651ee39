"""A small register that keeps a query next to its SQL twin."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def keep(function):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return keep
