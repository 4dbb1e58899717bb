"""DataFrame -> DataFrame operators."""

from kpiloom.operators.aggregates import (  # noqa: F401
    LEVEL_COL, append_total, cohort_counts, first_by, level_sets, repeat_rate,
)
from kpiloom.operators.grid import (  # noqa: F401
    DateRange, date_series, date_span, densify, expand, param_grid, pivot_fixed, values_frame,
)
from kpiloom.operators.relational import (  # noqa: F401
    drop_suffix_users, exclude_accounts, in_window, join_with_suffix, keep_matching,
    left_join_renamed,
    mark, null_safe_left_join,
)
from kpiloom.operators.windows import peaks, top_n  # noqa: F401
