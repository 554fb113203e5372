"""Places of pattern matches in texts, in DataFrame functions only.

Spark finds all matches of a pattern, and the pieces between them, but not
where they are. The places follow from the lengths of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def _starts(parts: Column, found: Column) -> Column:
    """Start of each match, from the pieces between matches; sums go by blocks, so many matches stay cheap."""
    n = F.size(found)
    index = F.sequence(F.lit(0), n - 1)
    lens = F.transform(index, lambda i: (F.char_length(F.get(parts, i)) + F.char_length(F.get(found, i))).cast("long"))

    def with_lens(ls: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(ls, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda bl: F.transform(index, lambda i: _total(F.slice(bl, F.lit(1), F.floor(i / BLOCK).cast("int"))) + _total(F.slice(ls, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)) + F.char_length(F.get(parts, i))))

    return F.when(n > 0, let(lens, with_lens)).otherwise(F.array().cast("array<bigint>"))


def matches(df: DataFrame, pattern: str, needs: str, text: str, name: str, check: Callable[[Column], Column], context: int) -> DataFrame:
    """Add ``name``: array of the matches of ``pattern`` in the column ``text`` (not null).

    A match is ``(s, e, t, b, a, ok)``: start and end in code points, its text,
    up to ``context`` characters before and after (within the piece between
    two matches), and ``check`` of its text. ``needs`` is a cheap pattern that
    every text with a match has.
    """
    none = F.array().cast("array<string>")
    # Bound by lambdas, not by columns: the optimiser may put a column's
    # expression into the lambda that uses it, and then it runs for each match.
    found = F.when(F.rlike(text, F.lit(needs)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)

    def placed(f: Column) -> Column:
        parts = F.when(F.size(f) > 0, F.split(text, pattern, -1)).otherwise(none)
        return let(parts, lambda p: let(_starts(p, f), lambda s: F.transform(f, lambda m, i: one(m, i, p, s))))

    def one(m: Column, i: Column, p: Column, s: Column) -> Column:
        start = F.get(s, i)
        return F.struct(
            start.alias("s"), (start + F.char_length(m)).alias("e"), m.alias("t"),
            F.right(F.get(p, i), F.lit(context)).alias("b"), F.left(F.get(p, i + 1), F.lit(context)).alias("a"), check(m).alias("ok"),
        )

    return df.withColumn(name, let(found, placed))
