"""Registered queries: each operator over the given tables, with SQL to check it.

A query is ``name -> (function(spark, sf_dir), sql or None)``.
"""

from sealgrade.catalog import dashboard, learning, streams, tables, text, verdicts

REGISTRY: dict = {}
for _module in (dashboard, learning, text, verdicts, tables, streams):
    REGISTRY.update(_module.QUERIES)
