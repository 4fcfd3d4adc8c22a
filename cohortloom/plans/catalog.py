"""All registered queries and their SQL."""

from __future__ import annotations

from cohortloom.plans import data_ops, describe_ops, model_ops, pipeline_ops, trait_ops

MODULES = (data_ops, describe_ops, trait_ops, model_ops, pipeline_ops)
QUERIES = {name: fn for m in MODULES for name, fn in m.query.queries.items()}
SQL = {name: text for m in MODULES for name, text in m.query.sql.items()}
