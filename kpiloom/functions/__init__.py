"""Column-level helpers (NULL semantics, buckets, path parts)."""

from kpiloom.functions.semantics import (  # noqa: F401
    blank_to_null, bucket, channel_of_delivery_method, fill_missing, flag_decode,
    if_else, in_set, money, n_distinct, not_in_set, path_part, ratio, ship_status_simple,
    sql_not_in, strict_sum, to_day, weekend_window_start, zero_fill,
)
