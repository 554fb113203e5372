"""Column expressions over vectors stored as ``array<double>``.

Every function here returns a :class:`pyspark.sql.Column`, so it runs inside
the JVM and, where the vector width is known, inside whole-stage codegen.
When ``dim`` is given the sums are written out term by term
(``t0 + t1 + ...``, left to right), which codegen compiles to straight-line
code; without it a higher-order ``aggregate`` fold is used. Both add the
terms in the same order, so they give bit-equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widths beyond this are folded with ``aggregate`` instead of unrolled, so the
# generated Java method stays well under the JVM's 64 KB limit.
MAX_UNROLLED_WIDTH = 256


def as_array(df: DataFrame, name: str) -> Column:
    """``df[name]`` as ``array<double>``.

    Accepts ``array`` of any numeric type (cast, so ``float`` becomes double
    before any subtraction) and ML ``Vector`` columns (dense or sparse).
    """
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, VectorUDT):
        return vector_to_array(col, "float64")
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.DoubleType):
            return col
        if isinstance(dtype.elementType, T.NumericType):
            return col.cast("array<double>")
    raise TypeError(f"column {name!r} is {dtype.simpleString()}, not a numeric array or vector")


def _unroll(dim: int | None) -> bool:
    return dim is not None and 0 < dim <= MAX_UNROLLED_WIDTH


def sqdist_sql(a: str, b: str, dim: int | None = None) -> str:
    """SQL text of :func:`sqdist` over SQL expressions ``a`` and ``b``.

    Built as text and parsed once by Spark: one call instead of several
    hundred Py4J calls for a 64-wide vector.
    """
    if _unroll(dim):
        return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(dim)) + ")"
    return f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (acc, x) -> acc + x)"


def sqdist_const_sql(a: str, center, dim: int) -> str:
    """SQL text of the squared distance from ``a`` to a constant vector, unrolled.

    The constant is written into each term, so the expression needs no
    array lookups on the constant side and compiles to straight-line code.
    """
    terms = []
    for i in range(dim):
        c = double_sql(center[i])
        terms.append(f"({a}[{i}] - {c}) * ({a}[{i}] - {c})")
    return "(" + " + ".join(terms) + ")"


def sqnorm_sql(a: str, dim: int | None = None) -> str:
    if _unroll(dim):
        return "(" + " + ".join(f"{a}[{i}] * {a}[{i}]" for i in range(dim)) + ")"
    return f"aggregate({a}, 0D, (acc, x) -> acc + x * x)"


def _sql(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass column names (str) to the SQL-text builders")


def sqdist(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    """Squared Euclidean distance ``sum((a[i] - b[i])^2)``, exact, in index order.

    With column names the expression is parsed from SQL text (fast to build);
    with Column objects it is composed from Column operators.
    """
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(sqdist_sql(_sql(a), _sql(b), dim))
    a, b = _col(a), _col(b)
    if _unroll(dim):
        return reduce(lambda x, y: x + y, [(a[i] - b[i]) * (a[i] - b[i]) for i in range(dim)])
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def distance(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    """Euclidean distance, ``sqrt`` of :func:`sqdist`."""
    return F.sqrt(sqdist(a, b, dim))


def fast_sqdist(a: str, a_norm: str, b: str, b_norm: str, dim: int | None = None, precision: float = 1e-6) -> Column:
    """Squared distance from stored norms, ``|a|^2 + |b|^2 - 2 a.b``, where that is good to ``precision``.

    Rounding costs at most ``16 eps (dim + 4) (|a|^2 + |b|^2)``; where this may exceed
    ``precision`` of the result (the vectors are close for their length), the
    distance is taken element by element.
    """
    if precision <= 0:
        raise ValueError("precision must be positive")
    x, y = _sql(a), _sql(b)
    if _unroll(dim):
        dot = "(" + " + ".join(f"{x}[{i}] * {y}[{i}]" for i in range(dim)) + ")"
        wide = f"{dim + 4}"
    else:
        dot = f"aggregate(zip_with({x}, {y}, (u, v) -> u * v), 0D, (acc, z) -> acc + z)"
        wide = f"(size({x}) + 4)"
    size = f"({_sql(a_norm)} * {_sql(a_norm)} + {_sql(b_norm)} * {_sql(b_norm)})"
    near = f"({size} - 2D * {dot})"
    good = f"{double_sql(16 * 2.0**-53)} * {wide} * {size} <= {double_sql(precision)} * {near}"
    return F.expr(f"CASE WHEN {good} THEN {near} ELSE {sqdist_sql(x, y, dim)} END")


def sqnorm(a: Column | str, dim: int | None = None) -> Column:
    """Squared L2 norm ``sum(a[i]^2)``."""
    if isinstance(a, str):
        return F.expr(sqnorm_sql(_sql(a), dim))
    if _unroll(dim):
        return reduce(lambda x, y: x + y, [a[i] * a[i] for i in range(dim)])
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(a: Column | str, dim: int | None = None) -> Column:
    """L2 norm of a vector."""
    return F.sqrt(sqnorm(a, dim))


def checked_width(a: Column, dim: int) -> Column:
    """``a`` itself when it has ``dim`` elements or is null; an error otherwise.

    Guards the unrolled expressions, which would otherwise silently ignore
    extra elements.
    """
    return F.when(a.isNull() | (F.size(a) == dim), a).otherwise(
        F.raise_error(F.concat(F.lit(f"vector width differs from {dim}: "), F.size(a).cast("string")))
    )


def usable(name: str) -> Column:
    """The vector is there and all its elements are finite numbers."""
    bad = f"exists(`{name}`, x -> x IS NULL OR isnan(x) OR abs(x) = CAST('Infinity' AS DOUBLE))"
    return F.expr(f"`{name}` IS NOT NULL AND NOT coalesce({bad}, true)")


def double_sql(x: float) -> str:
    """A double literal in Spark SQL text that parses back to exactly ``x``."""
    x = float(x)
    if x != x:
        return "CAST('NaN' AS DOUBLE)"
    if x in (float("inf"), float("-inf")):
        return f"CAST('{'-' if x < 0 else ''}Infinity' AS DOUBLE)"
    return f"{x!r}".upper() + "D"


def vector_sql(values) -> str:
    """SQL text of a constant ``array<double>``."""
    return "array(" + ", ".join(double_sql(v) for v in values) + ")"

