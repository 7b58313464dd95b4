"""Times as text and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def ms_of(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.bround(seconds * 1000).cast("bigint")


def hms(ms: Column) -> Column:
    """HH:MM:SS of milliseconds; what is before the start counts as the start."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    return F.concat_ws(":", F.when(s >= 360000, F.floor(s / 3600).cast("string")).otherwise(_two(F.floor(s / 3600).cast("bigint"))), _two(F.floor(s / 60).cast("bigint") % 60), _two(s % 60))


def cue_time(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    at = F.greatest(ms, F.lit(0))
    return F.concat(hms(at), F.lit(mark), F.lpad((at % 1000).cast("string"), 3, "0"))


def duration_text(ms: Column) -> Column:
    """Hours, minutes and seconds in Japanese, without leading parts that are zero."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60
    return F.when(h > 0, F.concat(h, F.lit("時間"), m, F.lit("分"), r, F.lit("秒"))).when(m > 0, F.concat(m, F.lit("分"), r, F.lit("秒"))).otherwise(F.concat(r, F.lit("秒")))


def parse_seconds(text: Column) -> Column:
    """Seconds of 'S', 'M:S' or 'H:M:S' with a dot or comma before fractions; null for anything else."""
    t = F.translate(F.trim(text), ",", ".")
    part = F.split(t, ":")
    n = lambda i: F.get(part, F.lit(i)).try_cast("double")
    plain = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    return F.when(F.size(part) == 1, plain).when(F.size(part) == 2, n(0) * 60 + n(1)).when(F.size(part) == 3, n(0) * 3600 + n(1) * 60 + n(2))


def name_date(name: Column) -> Column:
    """The date (YYYY-MM-DD) that a file name or label shows, or null if it shows none that exists."""
    found = F.regexp_extract(name, r"(20\d{2})[-_.年](\d{1,2})[-_.月](\d{1,2})", 0)
    group = lambda i: F.regexp_extract(name, r"(20\d{2})[-_.年](\d{1,2})[-_.月](\d{1,2})", i)
    text = F.concat_ws("-", group(1), F.lpad(group(2), 2, "0"), F.lpad(group(3), 2, "0"))
    return F.when(found != "", text.try_cast("date").cast("string"))
