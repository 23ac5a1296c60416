"""Text and number normalisation as native column expressions (no Python UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: characters whose full case folding differs from Spark's lower() in a way that
# matters for an [a-z0-9] filter. Replacement text after lower(); a space stands for the
# non-ASCII remainder of the folded form, which becomes a separator anyway.
CASEFOLD_EXTRA = [
    ("ß", "ss"), ("ŉ", " n"), ("ſ", "s"), ("ǰ", "j "), ("ẖ", "h "), ("ẗ", "t "), ("ẘ", "w "),
    ("ẙ", "y "), ("ẚ", "a "), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("ﬅ", "st"), ("ﬆ", "st"),
]

# A plain decimal or scientific number after trimming (what both Python float() and a SQL cast
# accept; suffixes such as 1.0d or 1f are rejected on purpose). Group 1 is the number without the white space around it.
NUMBER_RE = r"(?U)^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"

PLAIN_NUMBER_RE = r"^[0-9]+(?:\.[0-9]+)?\z"  # the commonest form, told without looking for white space, signs or exponents

NOT_BLANK_RE = r"(?U)\S"


def strip(c: Column) -> Column:
    """Leading and trailing white space removed (any Unicode white space, not only blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def round_to(x: Column, places: int) -> Column:
    """Rounded as the printed value is: from the exact binary value, ties to even (2.675 -> 2.67)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places)).try_cast("double")


def casefold(c: Column) -> Column:
    """Folded text; one of ASCII characters alone (as many bytes as characters) has none of the special ones."""
    out = F.lower(c)
    for src, dst in CASEFOLD_EXTRA:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(out)


def norm_text(c: Column) -> Column:
    """Case-insensitive, punctuation-blind form: runs outside [a-z0-9] become one space; null is ''."""
    return F.trim(F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def same_text(a: Column, b: Column) -> Column:
    """Whether the normalised forms are equal; equal texts have equal forms and are not normalised."""
    return a.eqNullSafe(b) | (norm_text(a) == norm_text(b))


def parse_number(s: Column) -> Column:
    """Trimmed text to double when it is a plain number, else null (never raises under ANSI). The text is matched once; what
    is not a number never reaches the cast."""
    return F.get(F.regexp_extract_all(s, F.lit(NUMBER_RE), F.lit(1)), F.lit(0)).try_cast("double")


def without(c: Column, characters: str) -> Column:
    """The text without these characters."""
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def score_number(c: Column) -> Column:
    """Prediction money as a number: drop ',' and '$'; empty or unparsable is null."""
    return F.when(c.rlike(PLAIN_NUMBER_RE), c.try_cast("double")).otherwise(parse_number(without(c, ",$")))


def plain_numbers(*texts: Column) -> tuple[Column, list[Column]]:
    """Lists of texts as lists of numbers, and whether each text of all lists is a number written with digits and points alone
    (for such, every reading of numbers here has this value). Compiled, without lambdas; a list with an unknown number (for
    which ``array_contains`` is null) or with very long texts counts as not plain."""
    numbers = [c.try_cast("array<double>") for c in texts]
    written = F.concat_ws(" ", *[F.array_join(c, " ") for c in texts])
    plain = (F.char_length(written) < 300) & ~written.rlike("[^0-9. ]")
    for n in numbers:
        plain = plain & ~F.array_contains(n, F.lit(float("nan")))
    return F.coalesce(plain, F.lit(False)), numbers


def review_norm(c: Column) -> Column:
    """Comparable form of a reviewed value: a number rounded to 2 places when the text (commas
    removed) is numeric, otherwise the trimmed text; null is ''. Tagged so 0 == 0.0 but never
    equal to the text '0.0'."""
    num = parse_number(without(c, ","))
    return F.when(num.isNotNull(), F.concat(F.lit("n:"), (round_to(num, 2) + F.lit(0.0)).cast("string"))) \
        .otherwise(F.concat(F.lit("s:"), strip(F.coalesce(c, F.lit("")))))


def clean_money_input(c: Column) -> Column:
    """Reviewer money input with ',', '$' and '€' removed."""
    return without(c, ",$€")


def parse_money_input(c: Column) -> Column:
    """Reviewer money input: blank is 0.0, a number is itself, anything else is null (rejected)."""
    s = clean_money_input(c)
    return F.coalesce(parse_number(s), F.when(~s.rlike(NOT_BLANK_RE), F.lit(0.0)))


def money_input_invalid(c: Column) -> Column:
    s = clean_money_input(c)
    return parse_number(s).isNull() & s.rlike(NOT_BLANK_RE)


def first_group(text: Column, pattern: str, case_insensitive: bool = True) -> Column:
    """First capture group of the first match, stripped; null when there is no match."""
    flags = "(?iUd)" if case_insensitive else "(?Ud)"
    return F.nullif(strip(F.regexp_extract(text, flags + pattern, 1)), F.lit(""))
