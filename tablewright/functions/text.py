"""Text-cleaning expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, signs, units and formats that decide the results.
TRUE_TOKENS = ["1", "1.0", "true", "t", "y", "yes", "enabled", "active"]
FALSE_TOKENS = ["0", "0.0", "false", "f", "n", "no", "disabled", "inactive"]
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PLAIN_NUMBER = r"^[+-]?\d+(\.\d+)?$"
ANY_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SIGNED_NUMBER = r"^-?\d+(\.\d+)?$"
ISO_OR_DAY_FIRST = r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})"
UNIT_TEXT = r"^\s*([0-9.]+)\s*([a-z\s]+)\s*$"
# shape of the text, and the formats it can have, in order of precedence
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", ["MMM d, yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", ["MMM d yyyy"]),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", ["MMMM d, yyyy"]),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", ["MMMM d yyyy"]),
]
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?$"
WEIGHT_NAMES = ["weight", "mass", "load"]
LENGTH_NAMES = ["length", "height", "width", "size", "distance"]
WEIGHT_UNITS = {
    ("g", "gram", "grams"): 1 / 1000.0,
    ("lb", "lbs", "pound", "pounds"): 1 / 2.20462,
    ("kg", "kilogram", "kilograms"): 1.0,
}
LENGTH_UNITS = {
    ("cm", "centimeter", "centimeters"): 1 / 100.0,
    ("in", "inch", "inches"): 0.0254,
    ("m", "meter", "meters"): 1.0,
}


def tidy_spaces(c: Column) -> Column:
    """Runs of white space, no-break spaces too, become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def guarded_double(c: Column) -> Column:
    """A double if the text is written as a number; not for NaN, 12D or 3f, which a cast would take."""
    text = tidy_spaces(c)
    return F.when(text.rlike(ANY_NUMBER), text.try_cast("double"))


def blank_to_null(c: Column) -> Column:
    return F.when(tidy_spaces(c) != "", c)


def as_boolean(c: Column) -> Column:
    token = F.lower(tidy_spaces(c.cast("string")))
    return F.when(token.isin(TRUE_TOKENS), F.lit(True)).when(
        token.isin(FALSE_TOKENS), F.lit(False)
    )


def as_timestamp(c: Column) -> Column:
    """The first format that fits; text in none of them becomes null.

    A value is parsed only in the formats of its shape, mostly one.
    """
    text = tidy_spaces(c)
    out = F.when(text.rlike(ISO_TIME), text.try_cast("timestamp"))
    for shape, formats in DATE_SHAPES:
        named = F.initcap(text) if "A-Z" in shape and " " in formats[0] else text
        out = out.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(named, F.lit(f)) for f in formats]))
    return out


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital, as in ``O'Neil Abc1Def``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def to_case(c: Column, style: str) -> Column:
    return {"title": title_case, "upper": F.upper, "lower": F.lower}[style](c)


def as_currency(c: Column) -> Column:
    """Signs, commas, blanks and % removed; any minus in the text makes it negative."""
    digits = guarded_double(F.regexp_replace(c, r"(?U)[$,€£%\s+\-]", ""))
    return F.when(c.contains("-"), -digits).otherwise(digits)


def as_percent(c: Column) -> Column:
    text = tidy_spaces(c)
    number = guarded_double(F.regexp_replace(text, "[,%]", ""))
    return F.when(text.rlike(r"^[^%]*%$"), number / 100)


def as_number(c: Column) -> Column:
    """Plain numbers, with or without thousands commas; everything else null."""
    text = F.regexp_replace(tidy_spaces(c), ",", "")
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def as_money(c: Column) -> Column:
    """A plain number after removing one or more currency signs and commas."""
    text = F.trim(F.regexp_replace(tidy_spaces(c), "[$£€¥₹,]", ""))
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def as_email(c: Column) -> Column:
    text = F.lower(tidy_spaces(c))
    return F.when(text.rlike(EMAIL), text)


def as_phone(c: Column) -> Column:
    """Digits with an optional leading +; text without 7 to 15 digits stays as it is."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    plus = F.regexp_replace(c, "[^0-9+]", "").startswith("+")
    fits = F.length(digits).between(7, 15)
    return (
        F.when(digits == "", c)
        .when(plus & fits, F.concat(F.lit("+"), digits))
        .when(plus | fits, digits)
        .otherwise(c)
    )


def unit_scale(name: str) -> dict | None:
    """The unit table a column name asks for."""
    lowered = name.lower()
    if any(w in lowered for w in WEIGHT_NAMES):
        return WEIGHT_UNITS
    if any(w in lowered for w in LENGTH_NAMES):
        return LENGTH_UNITS
    return None


def in_base_unit(c: Column, units: dict) -> Column:
    """``number unit`` text in kilograms or metres; anything else null."""
    text = F.lower(tidy_spaces(c.cast("string")))
    number = guarded_double(F.regexp_extract(text, UNIT_TEXT, 1))
    unit = F.trim(F.regexp_extract(text, UNIT_TEXT, 2))
    out = None
    for names, factor in units.items():
        hit = unit.isin(list(names))
        out = F.when(hit, number * factor) if out is None else out.when(hit, number * factor)
    return out
