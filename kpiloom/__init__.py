"""kpiloom: retail KPI reports as lazy Spark DataFrame operators.

Layout
------
functions/  Column-level helpers with explicit NULL semantics.
operators/  DataFrame -> DataFrame building blocks (joins, grids, rollups, top-k).
sources/    Readers (JDBC / Parquet / CSV), ingest normalisation, sinks, test bindings.
plans/      Dimensions, cleaned facts and the report compositions.
streaming/  Empty on purpose: the reports are bounded batch queries.
"""

from kpiloom.params import ReportParams
from kpiloom.session import build_session, ensure_checkpoint_dir

__all__ = ["ReportParams", "build_session", "ensure_checkpoint_dir"]
