"""The subpackage's queries and their DuckDB SQL, as ``__spark_entry__`` adds them.

``corpus_pipeline`` at the top of the repository counts as part of this subpackage;
one that lies elsewhere on the path is another repository's.
"""

from pathlib import Path

import corpus_pipeline

from . import oracle, queries

if Path(corpus_pipeline.__file__).resolve().parent != Path(__file__).resolve().parents[2]:
    raise ImportError(f"corpus_pipeline of another repository: {corpus_pipeline.__file__}")

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = {k: v for k, v in {**oracle.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
