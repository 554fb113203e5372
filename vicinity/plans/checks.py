"""Size guards for the few things that reach the driver or are broadcast.

Only tables with a bound known in advance (cell centres and per-cell counts,
both at most ``max_cells`` rows) are ever collected; the bound is checked
before the rows come back, never after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Upper bound on centre values (cells x width) placed in a plan as a literal.
MAX_LITERAL_VALUES = 2_000_000


class TooLarge(ValueError):
    """A table that should be small is not."""


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """``df.collect()`` for a table proven to hold at most ``max_rows`` rows.

    Fetches at most ``max_rows + 1`` rows, so an unexpectedly large table
    fails fast instead of flooding the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLarge(f"{what}: more than {max_rows} rows")
    return rows


def check_literal_size(n_cells: int, dim: int) -> None:
    if n_cells * max(dim, 1) > MAX_LITERAL_VALUES:
        raise TooLarge(
            f"{n_cells} centres of width {dim} exceed {MAX_LITERAL_VALUES} values; lower max_cells"
        )


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text (for plan tests and the bench log)."""
    jdf = df._jdf
    return jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )
