"""PostgreSQL-flavoured scalar functions as expressions that Catalyst sees through.

Each takes and returns columns. Where Spark has the same function under the same rules, use
Spark's; here are those whose rules differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_div(a, b) -> Column:
    """Quotient of integers, truncated toward zero; an error for 0."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def add(a, b) -> Column:
    """Sum of integers in 64 bits, whatever the columns' width."""
    return _c(a).cast("long") + _c(b).cast("long")


def sub(a, b) -> Column:
    return _c(a).cast("long") - _c(b).cast("long")


def mul(a, b) -> Column:
    return _c(a).cast("long") * _c(b).cast("long")


def to_int(x) -> Column:
    """Number to integer, halves away from zero."""
    return F.round(_c(x)).cast("long")


def text_to_int(x) -> Column:
    return F.trim(_c(x)).cast("long")


def to_bool(x) -> Column:
    """Text to boolean: t, true, yes, on, 1 and f, false, no, off, 0 in any case; an error for others."""
    s = F.lower(F.trim(_c(x)))
    return (
        F.when(s.isNull(), F.lit(None).cast("boolean"))
        .when(s.isin("t", "true", "yes", "on", "1"), True)
        .when(s.isin("f", "false", "no", "off", "0"), False)
        .otherwise(F.raise_error(F.concat(F.lit("invalid input syntax for type boolean: "), s)).cast("boolean"))
    )


def text_of(x: Column, kind: str) -> Column:
    """Text of a value of the given Spark type: t and f for booleans, floats without a trailing .0."""
    if kind == "boolean":
        return F.when(x, "t").when(~x, "f")
    if kind in ("float", "double"):
        whole = (F.abs(x) < 1e15) & (x == F.floor(x).cast("double"))
        return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: text_of(e, "float")), ","), F.lit("]"))
    return x.cast("string")


def concat(*parts) -> Column:
    """Concatenation that takes null as empty."""
    return F.concat_ws("", *[_c(p) for p in parts])


def substring(s, start, length=None) -> Column:
    """Characters from start (1-based) for length; places before the text count against the length."""
    s, start = _c(s), _c(start)
    begin = F.greatest(start, F.lit(1))
    if length is None:
        return F.substr(s, begin)
    end = start + _c(length)
    bad = F.raise_error(F.lit("negative substring length not allowed")).cast("string")
    return F.when(_c(length) < 0, bad).otherwise(F.substr(s, begin, F.greatest(end - begin, F.lit(0))))


def left(s, n) -> Column:
    """First n characters; for negative n all but the last -n."""
    s, n = _c(s), _c(n)
    return F.substr(s, F.lit(1), F.greatest(F.when(n < 0, F.length(s) + n).otherwise(n), F.lit(0)))


def right(s, n) -> Column:
    """Last n characters; for negative n all but the first -n."""
    s, n = _c(s), _c(n)
    return F.when(n < 0, F.substr(s, 1 - n)).otherwise(F.substr(s, F.greatest(F.length(s) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))))


def btrim(s, chars=" ") -> Column:
    return F.btrim(_c(s), _c(chars))


def ltrim(s, chars=" ") -> Column:
    return F.ltrim(_c(s), _c(chars))


def rtrim(s, chars=" ") -> Column:
    return F.rtrim(_c(s), _c(chars))


def length(s) -> Column:
    return F.length(_c(s)).cast("long")


def strpos(s, part) -> Column:
    """Place of the first occurrence from 1, 0 if there is none."""
    return F.call_function("instr", _c(s), _c(part)).cast("long")


def replace(s, old, new) -> Column:
    return F.replace(_c(s), _c(old), _c(new))


def split_part(s, delimiter, n) -> Column:
    return F.split_part(_c(s), _c(delimiter), _c(n))


def round_(x, digits: int | None = None) -> Column:
    """Halves away from zero: an integer without digits, a double with them."""
    return to_int(x) if digits is None else F.round(_c(x), digits).cast("double")


def ceil(x) -> Column:
    return F.ceil(_c(x)).cast("long")


def floor(x) -> Column:
    return F.floor(_c(x)).cast("long")


def power(x, y) -> Column:
    return F.pow(_c(x).cast("double"), _c(y).cast("double"))


def sqrt(x) -> Column:
    return F.sqrt(_c(x).cast("double"))
