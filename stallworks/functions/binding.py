"""Bind a computed value to a name inside one Column expression.

Column expressions are trees: a value that an expression mentions n times is
planned (and, outside common-subexpression elimination, evaluated) n times, and
nesting multiplies that.  ``let`` evaluates the value once and keeps the tree
linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
