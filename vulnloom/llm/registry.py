"""All queries of this package and the SQL that states their results, where SQL can."""

from __future__ import annotations

import corpus_pipeline
from vulnloom.llm.oracles import ORACLES as ORACLES
from vulnloom.llm.queries import QUERIES as OPERATORS

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}
