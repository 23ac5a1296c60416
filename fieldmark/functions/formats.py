"""Display formats: money, percentages, values, labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMPTY_MARK, FIELD_LABELS, MODEL_SHORT, MONEY_FIELDS
from .text import parse_number


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def model_short(model: Column) -> Column:
    """Short display name of a model id; unknown ids pass through."""
    return F.coalesce(map_literal(MODEL_SHORT)[model], model)


def field_label(field: Column) -> Column:
    return F.coalesce(map_literal(FIELD_LABELS)[field], field)


def pct(x: Column) -> Column:
    """Whole percent when within 0.05 of one, else one decimal: 0.5 -> 50%, 0.4467 -> 44.7%."""
    p = x * 100
    return F.when(F.abs(p - F.bround(p, 0)) < 0.05, F.format_string("%.0f%%", F.bround(p, 0))) \
        .otherwise(F.concat(fixed(p, 1), F.lit("%")))


def fixed(x: Column, places: int) -> Column:
    """Fixed decimals of the exact binary value, ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places if places else "0"))


def fmt_value(field: str, v: Column) -> Column:
    """Display value: empty or null is a dash; money with thousands and two decimals."""
    s = v.cast("string")
    empty = v.isNull() | (s == "")
    if field in MONEY_FIELDS:
        n = parse_number(s)
        shown = F.when(n.isNotNull(), F.format_number(n, 2)).otherwise(s)
    else:
        shown = s
    return F.when(empty, F.lit(EMPTY_MARK)).otherwise(shown)
