"""Queries, one for each operator; importing the package registers them all."""

import importlib

for _part in ("metrics", "windows", "evidence", "texts", "relational", "audits", "learned", "inputs", "rows", "choices", "words", "stored", "subgraph", "annotated", "scoring", "sweeps"):
    importlib.import_module(f"tripleforge.plans.{_part}")
