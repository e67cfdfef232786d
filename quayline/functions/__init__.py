from quayline.functions.columns import (  # noqa: F401
    blank_to_null,
    clock_secs,
    clock_text,
    code_or_default,
    gtfs_date,
    half_up,
    hour_band,
    is_digits,
    pct,
    ratio,
    frequency_class,
)
