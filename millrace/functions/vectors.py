"""Vector distances as built-in higher-order expressions: no UDF, so they fold, prune and generate code.

A null operand gives null; operands of different dimensions are an error. ``exact=True``
computes in doubles throughout; the default keeps single precision to the end, as vectors
are stored, and widens the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term, exact: bool) -> Column:
    kind = "double" if exact else "float"
    a, b = a.cast(f"array<{kind}>"), b.cast(f"array<{kind}>")
    total = F.aggregate(F.zip_with(a, b, term), F.lit(0).cast(kind), lambda s, x: s + x)
    wrong = F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast(kind)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast(kind)).when(F.size(a) != F.size(b), wrong).otherwise(total)


def dot(a: Column, b: Column, exact: bool = False) -> Column:
    return _fold(a, b, lambda x, y: x * y, exact)


def l2(a: Column, b: Column, exact: bool = False) -> Column:
    out = F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y), exact))
    return (out if exact else out.cast("float")).cast("double")


def negative_inner_product(a: Column, b: Column, exact: bool = False) -> Column:
    return -dot(a, b, exact).cast("double")


def cosine(a: Column, b: Column, exact: bool = False) -> Column:
    """1 - cos; 1 if a norm is 0."""
    norms = F.sqrt(dot(a, a, exact).cast("double")) * F.sqrt(dot(b, b, exact).cast("double"))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(a, b, exact).cast("double") / norms)


def parse(text: Column) -> Column:
    """`[1,2.5]` to a vector; an error if it is none or has no finite elements."""
    parts = F.split(F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1), ",")
    out = F.transform(parts, lambda x: F.trim(x).cast("float"))
    return F.when(text.isNull(), F.lit(None).cast("array<float>")).otherwise(out)


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, distance=l2, offset: int = 0, key: str | None = None, exact: bool = True) -> DataFrame:
    """Exact k nearest rows: one scan with a per-task heap; null vectors last, ties by key."""
    d = distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), exact)
    order = [F.asc_nulls_last("distance"), *([F.asc(key)] if key else [])]
    out = rows.withColumn("distance", d).orderBy(*order).limit(k + offset)
    return out.offset(offset) if offset else out


_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), float(0), (s, x) -> s + x)"
_SQUARE = "aggregate({}, float(0), (s, x) -> s + x * x)"
#: The distance operators as SQL text over the operands a and b.
SQL = {
    "<->": "sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), float(0), (s, x) -> s + x))",
    "<#>": f"-{_DOT}",
    "<=>": f"coalesce(1 - {_DOT} / nullif(sqrt({_SQUARE.format('{a}')}) * sqrt({_SQUARE.format('{b}')}), 0), if({{a}} is null or {{b}} is null, null, 1.0D))",
}


def distance_sql(operator: str, a: str, b: str) -> str:
    """SQL for ``a operator b``, an error if the dimensions differ."""
    body = SQL[operator].format(a=a, b=b)
    return f"if(size({a}) <=> size({b}) or {a} is null or {b} is null, cast({body} as double), raise_error('different vector dimensions'))"
