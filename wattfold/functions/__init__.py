"""Column expressions; all of them run inside the JVM."""

from wattfold.functions.columns import (
    bytes_to_gib,
    iso_micros_text,
    ordered_count_map,
    parse_timestamp,
    seconds_text,
)

__all__ = [
    "bytes_to_gib",
    "iso_micros_text",
    "ordered_count_map",
    "parse_timestamp",
    "seconds_text",
]
