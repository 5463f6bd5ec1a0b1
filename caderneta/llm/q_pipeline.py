"""The pipeline at the top of the repository as a query."""

from __future__ import annotations

import corpus_pipeline
from caderneta.llm.registry import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
