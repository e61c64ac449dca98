"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from . import detection, formats, mining, relational, sources, surface

MODULES = (formats, detection, mining, surface, relational, sources)


def queries():
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
