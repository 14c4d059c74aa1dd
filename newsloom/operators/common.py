"""Plan-shape helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns whose expressions are expensive and read several times downstream.

    Catalyst inlines a projected expression into every later reference (other projections, pushed
    down filters), so a regex chain referenced five times is evaluated five times.  Emitting the
    values through a one-element ``inline`` (a Generate node, codegen-friendly) computes each
    expression once per row: references above it read the generated attribute.
    """
    tmp = {n: f"__computed_{n}" for n in cols}
    fields = F.struct(*[e.alias(tmp[n]) for n, e in cols.items()])
    out = df.select("*", F.inline(F.array(fields)))
    out = out.drop(*[n for n in cols if n in df.columns])
    return out.withColumnsRenamed({tmp[n]: n for n in cols})
