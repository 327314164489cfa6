"""All core queries by name."""

from __future__ import annotations

from quillstone.plans import corpus, evaluation, pipelines, problems, runlog, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}

for _module in (evaluation, corpus, texts, runlog, pipelines, problems):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
