"""Collects queries and their SQL under one name."""


def registry():
    queries, oracles = {}, {}

    def query(name, sql=None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn
        return add

    return queries, oracles, query
