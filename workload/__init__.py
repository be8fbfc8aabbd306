"""Queries on the given tables: each a Spark function and, where SQL can say
it, the same in SQL."""

from workload import context, selection, tasklog

ALL = {}
for part in (selection, context, tasklog):
    ALL.update(part.QUERIES)
