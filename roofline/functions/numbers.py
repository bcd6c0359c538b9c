"""Number parsing and cell coercion.

All of these are built-in Column expressions: they stay inside whole-stage
codegen and push down wherever Catalyst can push them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Fixed value: the German number pattern.  Thousands groups with "." (and an
# optional decimal part with ","), or else plain digits with an optional
# ",decimals" part.  Alternatives are tried in this order at the leftmost match.
GERMAN_NUMBER = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?"

# Cell texts that mean "true".
TRUE_WORDS = ["1", "true", "yes", "on", "checked"]
# Setting texts that mean "true" (settings have no "checked").
TRUE_WORDS_SETTING = ["1", "true", "yes", "on"]


def parse_number(c) -> Column:
    """B1: first German-formatted number in a text, as double; null when none.

    ``1.250,00 €`` -> 1250.0, ``2,5 Zimmer`` -> 2.5, ``VB`` -> null.  The sign is
    ignored; ``.`` is a thousands separator and ``,`` the decimal mark.
    """
    raw = F.regexp_extract(col(c), GERMAN_NUMBER, 0)
    machine = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")
    return F.when(raw != "", machine.try_cast("double"))


def to_double_cell(c) -> Column:
    """A table cell as double.  Blank is null, numbers pass, text goes through B1."""
    c = col(c)
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(None).cast("double")) \
        .otherwise(F.coalesce(_numeric_or_null(c), parse_number(c.cast("string"))))


def _numeric_or_null(c: Column) -> Column:
    # A cell stored as a number keeps its value; text cells yield null here and
    # fall through to the German parser.  ``try_cast`` of "1.250" would be 1.25,
    # which is why text never takes this branch.
    return F.when(F.typeof(c).isin("tinyint", "smallint", "int", "bigint", "float", "double")
                  | F.typeof(c).startswith("decimal"), c.cast("double"))


def to_bool_cell(c, default: bool = True, words=TRUE_WORDS) -> Column:
    """Blank -> default; number -> != 0; text -> trimmed lower-case in the true words."""
    c = col(c)
    as_text = c.cast("string")
    numeric = _numeric_or_null(c)
    return (F.when(c.isNull() | (as_text == ""), F.lit(default))
            .when(F.typeof(c) == "boolean", c.cast("boolean"))
            .when(numeric.isNotNull(), numeric != 0)
            .otherwise(F.lower(_py_strip(as_text)).isin(*words)))


def to_double_setting(c) -> Column:
    """A setting as double: ``,`` becomes ``.``, then a plain float; bad text is null.

    Different from B12 on purpose: ``"1.250"`` is 1.25 here and 1250 there.
    """
    return F.regexp_replace(_py_strip(col(c)), ",", ".").try_cast("double")


def to_bool_setting(c, default: bool = False) -> Column:
    c = col(c)
    return F.when(c.isNull(), F.lit(default)).otherwise(F.lower(c).isin(*TRUE_WORDS_SETTING))


def retry_delay_seconds(attempt, retry_after=None) -> Column:
    """Seconds to wait after a failed retryable attempt (0-based).

    A numeric ``Retry-After`` wins (floored at 0), else 2^(attempt+1).
    """
    backoff = F.pow(F.lit(2.0), col(attempt) + 1)
    if retry_after is None:
        return backoff
    header = col(retry_after).cast("string").try_cast("double")
    return F.coalesce(F.when(header.isNotNull(), F.greatest(F.lit(0.0), header)), backoff)


def _py_strip(c: Column) -> Column:
    from .text import strip_text
    return strip_text(c)
