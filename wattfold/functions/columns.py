from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_GIB = 1024**3


def _ntz_text(ts: Column) -> Column:
    # date_format() goes through the session time zone, which moves wall-clock times
    # that fall into a daylight-saving gap. The plain cast never looks at the zone.
    return ts.cast("timestamp_ntz").cast("string")


def seconds_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; the fraction is cut off, not rounded."""
    return F.substring_index(_ntz_text(ts), ".", 1)


def iso_micros_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.ffffff``, always with six fraction digits."""
    text = _ntz_text(ts)
    fraction = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
    seconds = F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T"))
    return F.concat(seconds, F.lit("."), F.rpad(fraction, 6, "0"))


def parse_timestamp(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text to a zone-less timestamp."""
    return F.to_timestamp_ntz(text, F.lit(fmt))


def bytes_to_gib(size: Column) -> Column:
    """Bytes to GiB (1024³ bytes). The divisor is a power of two, so nothing is lost."""
    return size.cast("double") / F.lit(float(BYTES_PER_GIB))


def ordered_count_map(key: Column, n: Column, label: Column) -> Column:
    """Aggregate of counted keys: a map ordered by falling n, then by label.

    Keys are texts and differ from each other; ties are ordered by the label's own type.
    """
    entry = F.struct((-n).alias("minus_n"), label.alias("label"), key.alias("key"))
    entries = F.sort_array(F.collect_list(entry))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], -e["minus_n"])))
