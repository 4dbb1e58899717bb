"""Report sinks: CSV reports and dated multi-report bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpiloom.sources.bundles import (  # noqa: F401 - the bundle's names are part of this module
    Bundle, _null_texts, _one_file, clean_bundle, committed, read_bundle, stamp, write_bundle,
)


def csv_report(df: DataFrame, path: str, single_file: bool = False, null_value: str = "NA",
               mode: str = "overwrite", order=(), null_text: dict[str, str] | None = None) -> None:
    """Write a report as CSV with a header; NULL is written as ``NA``, in the
    columns of ``null_text`` as the text given there.

    ``single_file`` moves the finished rows to one partition, sorted by
    ``order`` -- only for grid-sized reports, never for detail tables.
    """
    df = _null_texts(df, null_text)
    out = _one_file(df, order) if single_file else df
    (out.write.mode(mode).option("header", True).option("nullValue", null_value)
     .option("emptyValue", "").csv(path))
