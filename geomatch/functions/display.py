"""Display text of numbers and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Splits a double into two parts of 26 bits, whose products with small whole numbers are exact.
_SPLITTER = float(2**27 + 1)
# Below this, the scaled value and its neighbours are exact whole numbers.
_EXACT_BELOW = float(2**52)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_fixed(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals (at most 7), rounded from its exact binary value,
    ties away from zero.

    With ``n`` units below the value, the question is on which side of the midpoint ``(2n + 1) /
    (2 * 10**digits)`` the value lies. The rounded midpoint answers it unless it equals the value;
    then the exact product of midpoint and divisor, a double plus its rounding error, decides.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    unit = float(10**digits)
    divisor = 2.0 * unit

    def excess(middle: Column, odd: Column) -> Column:
        """How far the rounded midpoint lies above the exact one, scaled by the divisor."""
        high = middle * _SPLITTER - (middle * _SPLITTER - middle)
        product = middle * divisor
        return (product - odd) + ((high * divisor - product) + (middle - high) * divisor)

    def units(size: Column) -> Column:
        def rounded(below: Column) -> Column:
            odd = below * 2.0 + 1.0
            return _let(
                odd / divisor,
                lambda middle: below
                + F.when((size > middle) | ((size == middle) & (excess(middle, odd) >= 0)), 1.0).otherwise(0.0),
            )

        return _let(F.floor(size * unit).cast("double"), rounded)

    def pointed(text: Column) -> Column:
        if digits == 0:
            return text
        padded = F.lpad(text, F.greatest(F.length(text), F.lit(digits + 1)), F.lit("0"))
        return F.regexp_replace(padded, "([0-9]{%d})$" % digits, ".$1")

    exact = _let(
        F.abs(value),
        lambda size: F.when(size * unit < _EXACT_BELOW, _let(units(size).cast("bigint").cast("string"), pointed)),
    )
    pattern = "0." + "0" * digits if digits else "0"
    return (
        F.when(F.isnan(value), "NaN")
        .when(exact.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), exact))
        .otherwise(F.call_function("format_number", value, F.lit(pattern)))
    )


def percent(value: Column, digits: int = 1) -> Column:
    """A ratio as a percentage text; missing counts as 0."""
    return F.concat(to_fixed(F.coalesce(value, F.lit(0.0)) * 100.0, digits), F.lit("%"))


def megabytes(size: Column) -> Column:
    """A byte count as megabytes with two decimals."""
    return F.concat(to_fixed(size.cast("double") / 1024.0 / 1024.0, 2), F.lit(" MB"))


def feature_text(value: Column, items: Column, raw: Column | None = None) -> Column:
    """Number -> four decimals, array -> ``[n items]``, anything else -> its JSON text."""
    text = F.when(value.isNotNull(), to_fixed(value, 4)).when(
        items.isNotNull(), F.concat(F.lit("["), F.size(items).cast("string"), F.lit(" items]"))
    )
    return text if raw is None else text.otherwise(raw)
