"""Date parsing and formatting as native column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import READER_DATE_FORMATS

# FIXED VALUES: the eight printed date styles, as Spark datetime patterns.
DATE_STYLES = {
    "iso": "yyyy-MM-dd",
    "us": "MM/dd/yyyy",
    "long": "MMMM d, yyyy",
    "dmy_long": "d MMMM yyyy",
    "eu_dot": "dd.MM.yyyy",
    "short": "MMM dd, yyyy",
    "dash_mon": "dd-MMM-yyyy",
    "slash_ymd": "yyyy/MM/dd",
}


# Text shapes that only some of the six formats can parse; a shape picks the formats worth
# trying, in the same order, so failed attempts are skipped (same first success).
_SHAPES = [
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", ["M/d/yyyy"]),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", ["yyyy-M-d"]),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", ["d.M.yyyy"]),
    (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$", ["MMMM d, yyyy", "MMM d, yyyy"]),
]


def parse_reader_date(s: Column) -> Column:
    """First of the reader's six formats that parses the trimmed text; null when none does."""
    t = F.trim(s)
    out = F.coalesce(*[F.try_to_date(t, fmt) for fmt in READER_DATE_FORMATS])
    for pattern, fmts in reversed(_SHAPES):
        out = F.when(t.rlike(pattern), F.coalesce(*[F.try_to_date(t, f) for f in fmts])).otherwise(out)
    return out


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")

